"""Vector tiles on Spark: features in, tile archives and tile analytics out."""
