"""Document retrieval, citation checking and evaluation statistics as Spark DataFrame operators."""
