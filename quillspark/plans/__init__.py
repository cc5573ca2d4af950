"""Whole operations put together from the operators."""
