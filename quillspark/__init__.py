"""Analytics over corpora of formal documents, as Spark DataFrame plans."""
