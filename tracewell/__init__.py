"""Side-channel trace analytics as Spark jobs."""
