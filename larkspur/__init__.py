"""Guarded read-only SQL, metadata relations, search, audits and incremental refresh on Spark DataFrames."""
