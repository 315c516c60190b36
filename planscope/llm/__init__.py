"""Training-data operators: fingerprints, deduplication, scanning, search, classification, mixing, tokens."""
