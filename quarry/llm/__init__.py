"""Training-data operators: near-dedup, line dedup, WARC, licences, mixing, media, quality, secrets, packing, sharding."""
