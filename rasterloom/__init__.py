"""Question-answer and raster-grid analytics expressed as Spark plans."""
