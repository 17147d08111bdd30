"""Training-data operators: search, scoring, cleaning, deduplication, mixing, packing."""
