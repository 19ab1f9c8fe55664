"""Relational operators: joins, aggregates, windows, sets, graphs."""
