"""Training-data operators: extraction, filtering, tokenising, deduplication, packing, search."""
