"""tessera: record linkage and corpus preparation as declarative Spark plans."""
