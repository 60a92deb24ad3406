"""Training-data operators: deduplication, quality, scoring, scanning, mixing and packing."""
