"""Column expressions and type rules shared by the operators."""
