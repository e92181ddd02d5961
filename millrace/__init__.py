"""millrace: a small analytics engine that declares its plans to Spark SQL."""
