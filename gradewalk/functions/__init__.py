"""Column builders: geometry, costs and text."""
