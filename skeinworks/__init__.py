"""Spark-first preparation and analysis of typed, multi-step text trajectories."""
