"""Readers, writers and the adapter for the test tables."""
