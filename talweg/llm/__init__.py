"""Operators for preparing training text: near-duplicates, tokens, licences, secrets, quality and the like.

Nothing outside this subpackage imports it.
"""
