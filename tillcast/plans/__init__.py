"""Whole jobs composed of operators."""
