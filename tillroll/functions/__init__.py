"""Column functions: money, text, clock and realm rules. All run inside the JVM; none is a UDF."""
