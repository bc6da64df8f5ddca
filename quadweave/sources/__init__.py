"""Scans: GeoJSON, line-delimited GeoJSON, CSV points, shapefiles, and tile archives."""
