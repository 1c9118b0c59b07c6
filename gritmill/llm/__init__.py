"""Operators for training data: secrets, survivorship, hand-written code, encoding, packing, stuffing."""
