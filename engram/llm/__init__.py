"""Operators for training-data pipelines: filtering, dedup, decontamination, tokenising, search and sharding."""
