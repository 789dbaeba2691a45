"""Storage-metadata and corpus analytics as Spark DataFrame programs."""
