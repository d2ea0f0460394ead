"""Operators on DataFrames: filters, index and search, joins, aggregations, table maintenance."""
