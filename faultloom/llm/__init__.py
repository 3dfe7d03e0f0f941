"""Training-data operators: dedup, archives, sharding, decontamination, classifiers, tokenising."""
