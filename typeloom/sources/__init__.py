"""Readers and writers: parquet tables, SQLite files, text exports."""
