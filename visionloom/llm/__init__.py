"""Training-data operators: sharding, media, toxicity, near-dedup, packing, quality, PII, language, archives, decontamination."""
