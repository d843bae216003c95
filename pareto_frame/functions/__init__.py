"""Column builders: dominance predicates and geometry."""
