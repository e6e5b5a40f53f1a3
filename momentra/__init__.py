"""Media-curation analytics as Spark DataFrame operators."""
