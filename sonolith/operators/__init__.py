"""Operators on sessions: DataFrame in, DataFrame out."""
