"""tessera: a Spark-first document retrieval and analytics engine."""
