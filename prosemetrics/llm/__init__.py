"""Operators of a training-data pipeline: near-duplicates, quality, tokens, URLs, shards, search,
packing, personal data and mixing.  Nothing else in the library imports this subpackage."""
