"""Queries: the operators applied to the test tables, each with the SQL it is held against."""
