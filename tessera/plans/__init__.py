"""Whole programs made of the operators."""
