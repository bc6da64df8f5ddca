"""Whole jobs: bake layers into an archive, inspect and query archives, answer tile requests."""
