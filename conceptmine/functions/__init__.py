"""Column expressions (all JVM side) used by the operators."""
