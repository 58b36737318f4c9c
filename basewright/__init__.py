"""Assembly-error calling from long-read alignments, as Spark DataFrame jobs."""
