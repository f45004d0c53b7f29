"""Column -> Column helpers; everything here stays inside the JVM."""
