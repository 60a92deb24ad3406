"""Whole jobs composed from sources, functions and operators."""
