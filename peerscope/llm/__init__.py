"""Operators for preparing training text: deduplication, tokens, language, packing, chat and URLs."""
