"""Training-data operators: WARC, deduplication, search, classification, packing and mixing."""
