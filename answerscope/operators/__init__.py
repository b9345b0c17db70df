"""Relational operators and metric tables, as DataFrame plans."""
