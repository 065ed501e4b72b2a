"""Column functions: everything here compiles to JVM expressions unless a docstring says otherwise."""
