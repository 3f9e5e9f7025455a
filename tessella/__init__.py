"""Tessella: a versioned log, replica repair and vector search as Spark DataFrame programs."""
