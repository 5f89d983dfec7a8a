"""Column functions: everything here stays inside the JVM and inside codegen where Spark allows."""
