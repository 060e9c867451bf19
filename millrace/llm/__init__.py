"""Operators for training data: quantile digests, packing, mixing and shared spans."""
