"""Training-data operators: scoring, packing, deduplication, filtering, archives, search, sharding."""
