"""Training-data operators: deduplication, quality, tokenisation, packing, sharding, search."""
