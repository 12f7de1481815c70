"""Operators for training data: splitting, term counts, canonical names, packing, leakage, encodings."""
