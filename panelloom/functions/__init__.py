"""Column and DataFrame primitives shared by the operators."""
