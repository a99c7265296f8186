"""Training-data operators: dedup, packing, scans, archives, counts, quality, extraction."""
