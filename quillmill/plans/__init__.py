"""Whole plans: searches made of the operators, the views of the given tables, and the registered queries."""
