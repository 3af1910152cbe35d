"""Training-data operators: deduplication, filtering, tokenizing and fingerprints."""
