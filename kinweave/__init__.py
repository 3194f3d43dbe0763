"""Related-party analytics over listed-company tables, as Spark DataFrame jobs."""
