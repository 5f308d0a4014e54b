"""Structured Streaming operators and the means to run them over files to the end."""
