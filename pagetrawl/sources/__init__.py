"""Readers and writers of the tables; every table is Parquet with a declared schema."""
