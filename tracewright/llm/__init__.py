"""Operators for training-data pipelines.

Nothing outside this package imports it: it can be removed as a whole.  Each
module holds one operator with its own general interface; ``queries`` holds
the thin registered queries over the synthetic tables.
"""
