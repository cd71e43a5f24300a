"""Operators for text collections: mail bodies, near-duplicates, name variants, packing, mixing, moderation.

Nothing outside this subpackage imports it.
"""
