"""Relational operators over the evidence tables."""
