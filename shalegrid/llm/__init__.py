"""Training-data operators: decontamination, tokenization, deduplication, privacy, extraction, secrets and quality."""
