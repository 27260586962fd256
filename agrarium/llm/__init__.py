"""Operators that prepare a text corpus for training language models.

Nothing outside this package imports it.
"""
