"""Graph operators: recursive paths, whole-graph algorithms, writes, introspection."""
