"""Training-data operators: dedup, search, tokenizing, classification, scans. Nothing else in the library imports this."""
