"""Training-data operators: tokenising, packing, coding, scoring, deduplication, PII and media."""
