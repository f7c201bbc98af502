"""A PySpark engine for evidence-aware retrieval, ranking and corpus analytics."""
