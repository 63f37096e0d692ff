"""Training-data operators: filtering, deduplication, mixing, packing and scoring of documents."""
