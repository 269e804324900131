"""Sumweave: batches of join-and-sum queries over integer tables, on Spark."""
