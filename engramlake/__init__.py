"""Knowledge-memory analytics on Spark: retrieval, graph, statistics and state operators as DataFrame plans."""
