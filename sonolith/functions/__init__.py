"""Scalar, array and statistical functions."""
