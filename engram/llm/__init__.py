"""Training-data operators: filtering, deduplication, mixing, formatting and storage of document collections."""
