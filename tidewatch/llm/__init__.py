"""Training-data operators: search, deduplication, quality, sharding, tokens, mixing."""
