"""Rules for annotations and results, as Column expressions."""
