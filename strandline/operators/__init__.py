"""Relational operators that Spark has no single call for, or whose plain form breaks on hot keys."""
