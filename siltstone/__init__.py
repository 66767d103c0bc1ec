"""Permission-aware retrieval, evaluation and corpus analytics on Spark."""
