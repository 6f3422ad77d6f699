"""corpusloom: document-corpus analytics and retrieval expressed as Spark DataFrame plans."""
