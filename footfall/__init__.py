"""Privacy-preserving web analytics as Spark jobs."""
