"""Columnar-file analytics on Spark: scans, sinks, nested data, encodings, statistics, membership and encryption."""
