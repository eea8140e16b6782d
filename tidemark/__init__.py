"""tidemark: panel, text and corpus operators written as Spark jobs."""
