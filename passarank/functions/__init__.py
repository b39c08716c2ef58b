"""Column functions: JVM-side expressions that stay inside code generation where Spark allows."""
