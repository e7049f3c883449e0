"""Column expressions on flowgrams, sequences and identifiers; all run inside Spark, without Python."""
