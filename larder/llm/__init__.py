"""Training-data operators: dedup, quality, decontamination, mixing, sharding, license and secret scans."""
