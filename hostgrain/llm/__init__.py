"""Training-data operators: filters, deduplication, decontamination, mixing, sharding."""
