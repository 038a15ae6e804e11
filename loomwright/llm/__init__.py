"""Operators for preparing training data: packing, near-duplicate joins, sharding, quality rules, token files,
repeated-passage removal, page text, source mixing, exact search and toxicity. Nothing else in the library imports it."""
