"""Column expressions and argument checks shared by the operators."""
