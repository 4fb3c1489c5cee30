"""Column-level functions (JVM side unless the docstring says otherwise)."""
