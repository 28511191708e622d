"""grafthorn: rule inference and shape conformance over RDF-style triples, as Spark DataFrame jobs."""
