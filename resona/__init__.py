"""resona: content-based similarity over large feature catalogues, as Spark jobs."""
