"""Operators for preparing training text: language, toxicity, duplicates, tokens, packing."""
