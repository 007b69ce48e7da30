"""A PySpark engine for recommender data: sources, preparation, splits, retrieval, metrics and models."""
