"""Training-data operators: near-duplicates, personal data, mixing, packed ids, toxicity, page text, decontamination, archives, shards, media."""
