"""Message-archive analytics and retrieval on PySpark."""
