"""Training-data operators: extraction, privacy, packing, mixing, deduplication, language."""
