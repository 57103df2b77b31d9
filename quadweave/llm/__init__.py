"""Operators for preparing training corpora: rules, tokens, pages, privacy, search, packing."""
