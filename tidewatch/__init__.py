"""Time-series anomaly detection and evaluation as Spark jobs."""
