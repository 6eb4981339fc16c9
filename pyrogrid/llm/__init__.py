"""Training-data operators: deduplication, packing, archives, language, mixing, search."""
