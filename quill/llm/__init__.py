"""Operators of a training-data pipeline (deduplication, quality, privacy,
mixing, tokenising, formatting), one module each.  Nothing else in the library
imports this subpackage; ``queries`` registers them."""
