"""Training-data operators: extraction, media columns, packing, mixing, quality, dedup, scans and token output."""
