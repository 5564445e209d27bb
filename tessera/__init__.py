"""Evidence retrieval and evaluation over document collections, as Spark DataFrame operators."""
