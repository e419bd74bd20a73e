"""Relational operators over the core tables."""
