"""Column expressions: coercion, text, calendar, measures and predicates.  No Python UDFs."""
