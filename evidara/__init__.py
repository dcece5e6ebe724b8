"""Evidence retrieval and corpus analytics as Spark plans."""
