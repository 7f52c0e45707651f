"""Scalar functions of the sample domain as Column expressions."""
