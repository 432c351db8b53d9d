"""Knowledge-graph analytics over documents, expressed as Spark DataFrame plans."""
