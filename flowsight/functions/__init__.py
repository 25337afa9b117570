"""Column expressions: everything here takes and returns columns and stays inside the JVM."""
