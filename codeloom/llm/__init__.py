"""Training-data operators: dedup, mixing, filters, tokens and fingerprints."""
