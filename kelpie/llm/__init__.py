"""Operators that prepare training text: deduplication, quality, mixing, tokens, privacy.

Nothing outside this subpackage imports it.
"""
