"""Sources and sinks: Parquet scans, footers, row groups, encrypted files, write options."""
