"""Training-data operators: packing, extraction, formatting, search, privacy, deduplication, toxicity, mixing, quality."""
