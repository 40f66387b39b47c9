"""Learning analytics and study-content retrieval as set-based Spark operators."""
