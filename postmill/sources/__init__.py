"""Readers, writers and small configuration tables."""
