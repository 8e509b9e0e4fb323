"""Training-data operators: deduplication, filtering, scanning, scoring and mixing of text corpora."""
