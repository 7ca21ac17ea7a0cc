"""Operators for preparing training text: deduplication, tokens, packing, scoring.

Nothing outside this folder imports it.
"""
