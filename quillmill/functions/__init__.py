"""Column functions: paths, text, extraction, journal records, rules."""
