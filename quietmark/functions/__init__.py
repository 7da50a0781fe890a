"""Column-level building blocks: patterns, predicates, placeholders, text helpers."""
