"""corvane: citation-evidence analytics as Spark DataFrame programs."""
