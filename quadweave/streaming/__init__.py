"""Extension: keep a folder of tiles up to date from a stream of line-delimited features."""
