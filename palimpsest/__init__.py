"""Session-aware retrieval analytics and corpus preparation on PySpark."""
