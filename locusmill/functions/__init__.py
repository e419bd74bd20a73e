"""Column functions; everything here stays on the JVM side."""
