"""Operators for training data: splitting, similarity, tokens, mixing, reading level.

Nothing outside this subpackage imports it.
"""
