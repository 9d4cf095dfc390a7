"""Query plans: MLlib pipelines, model registry, the query catalogue."""
