"""Training-data operators: deduplication, filtering, mixing, sharding, packing and search."""
