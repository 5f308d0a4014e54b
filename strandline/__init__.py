"""Table and stream operators for PySpark, written as DataFrame and Structured Streaming code."""
