"""Operators of a training-data pipeline: tokens, toxicity, quality, URLs, secrets, repeats, packing, licences, vectors."""
