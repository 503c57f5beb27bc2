"""Relational operators: upserts, key resolution, closure, canonicalisation, search."""
