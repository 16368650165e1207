"""Dataflow operators: schemas and levels, nested data, encodings, statistics, membership."""
