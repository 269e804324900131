"""Queries as they arrive: batches of lines, and streams of text files."""
