"""Relational operators: lookups, name links, ranks, filters, edits."""
