"""quarry: a Spark-first analytics engine for document catalogues."""
