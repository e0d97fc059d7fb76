"""Column-level building blocks: Column in, Column out, all JVM-side."""
