"""Operators on keyed tables: loading modes, shapes, filters, joins, intervals, aggregates."""
