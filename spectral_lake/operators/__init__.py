"""Operators from DataFrame to DataFrame; all lazy, all partitioned."""
