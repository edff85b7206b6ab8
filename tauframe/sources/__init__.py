"""Partitioned tables, SQL scans and CSV files."""
