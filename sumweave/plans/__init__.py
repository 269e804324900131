"""Query specifications: parsing, normalising, statistics and join order."""
