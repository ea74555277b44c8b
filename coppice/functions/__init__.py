"""Column expressions and schema checks."""
