"""Training-data operators: dedup, quality, language, sharding, packing, tokenizing and scoring."""
