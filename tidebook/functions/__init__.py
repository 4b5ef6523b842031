"""Column expressions over order-book ladders, sizes, rates and prices. All of them stay in the JVM."""
