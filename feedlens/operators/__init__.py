"""Relational operators: filters, dedupe, joins, merges, rule gates and matching."""
