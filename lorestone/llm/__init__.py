"""Training-data operators: mixing, filtering, near-duplicates, decontamination, scoring and sharding."""
