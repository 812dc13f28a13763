"""Training-data operators: language ID, deduplication, quality, packing, search, mixing, token output.

Nothing else in the library imports this package; `queries.py` registers its queries.
"""
