"""Training-data operators: language id, toxicity, decontamination, WARC derivatives, licence
digests, HTML extraction, packing, quality rules, near-duplicates and sharding."""
