"""Training-data operators: scans, deduplication, decontamination, language ID, scoring, packing, extraction."""
