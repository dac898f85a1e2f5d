"""Column expressions and row predicates shared by the operators."""
