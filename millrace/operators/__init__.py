"""Operators that Spark lacks or has no efficient plan for, as compositions of DataFrame operations."""
