"""Column functions: expressions that Catalyst sees whole."""
