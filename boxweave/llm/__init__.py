"""Operators for preparing training text: near copies, tokens, leaks, personal data, quality, media, language, shards."""
