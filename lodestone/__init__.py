"""lodestone: document-retrieval analytics and corpus preparation as Spark plans."""
