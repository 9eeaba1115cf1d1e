"""Column expressions and column-name rules shared by the operators."""
