"""Expressions by name (ufuncs) and NumPy-like functions of matrices (numpy_api)."""
