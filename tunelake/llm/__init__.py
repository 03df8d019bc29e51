"""Training-data operators: deduplication, search, scoring, encoding, packing, archives, pages."""
