"""Growing a lexical network from dictionary data, as Spark DataFrame jobs."""
