"""Column expressions: projections, curves, tile arithmetic and geometry structs."""
