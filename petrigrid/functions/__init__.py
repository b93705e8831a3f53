"""Column expressions (no UDFs): text, geometry, colour, display, scoring."""
