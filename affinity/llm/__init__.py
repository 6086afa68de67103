"""Operators that prepare text and set data for training corpora.

Nothing outside this package imports it.
"""
