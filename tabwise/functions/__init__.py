"""Column expressions: text, parsing and display helpers that stay inside the JVM."""
