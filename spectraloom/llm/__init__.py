"""Training-data operators: formatting, search, tokenising, filtering, mixing, sharding."""
