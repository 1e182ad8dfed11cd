"""Readers, writers and small dimension tables."""
