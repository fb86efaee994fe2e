"""Training-data operators: mixing, dedup, quality, extraction, packing, tokenising.

Nothing outside this package imports it.
"""
