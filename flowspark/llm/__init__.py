"""Training-data operators: archives, deduplication, tokenisation, mixing, scoring."""
