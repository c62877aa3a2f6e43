"""Column-level rules. All JVM-side expressions unless a docstring says Arrow."""
