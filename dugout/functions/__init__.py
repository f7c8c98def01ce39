"""Column-level helpers: null-safe predicates, names, chunks, probability expressions."""
