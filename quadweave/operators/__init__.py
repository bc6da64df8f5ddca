"""Relational operators over feature and tile rows, and the geometry and encoding kernels they call."""
