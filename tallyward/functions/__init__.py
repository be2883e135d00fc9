"""Column expressions: every function returns a ``Column`` and stays inside the JVM."""
