"""Operators for preparing training text: quality, packing, fingerprints, chat, tokens, dedup, secrets, language."""
