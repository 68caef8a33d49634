"""Operators for building training data: duplicates, leaks, packing, archives, languages, licences."""
