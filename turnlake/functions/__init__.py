"""Column functions (JVM-side expressions; no Python on the row path)."""
