"""bagtree: search by meaning over bags of vectors, as Spark DataFrame jobs."""
