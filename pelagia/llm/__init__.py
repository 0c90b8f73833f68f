"""Training-data operators: fingerprints, tokens, formatting, packing, filters, dedup."""
