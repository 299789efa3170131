"""Operators that prepare text and sequences for training language models.

Nothing outside this subpackage imports it.
"""
