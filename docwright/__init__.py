"""docwright: document retrieval and analytics expressed as Spark plans."""
