"""docspark: grounding statements in document collections, as PySpark DataFrame operators."""
