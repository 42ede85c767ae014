"""Training-data operators: text cleaning, dedup, tokenisation and packing.

Nothing else in the library imports this subpackage.
"""
