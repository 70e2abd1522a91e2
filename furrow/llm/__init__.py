"""Operators of a training-data pipeline: archives, quality, secrets, shards, extraction, decontamination, tokens, fingerprints,
similarity joins and repeated passages. Nothing else in the library imports this subpackage."""
