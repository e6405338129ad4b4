"""Operators for training data: overlaps, splits, text forms, labels, encodings, leaks, mixes, cuts."""
