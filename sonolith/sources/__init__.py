"""Readers and writers of session tables."""
