"""Operators for training data: language, duplicates, tokens, licences, scores, contamination, secrets and mixing."""
