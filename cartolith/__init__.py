"""Corpus cartography on Spark: classify, profile, roll up, lay out and query large file collections."""
