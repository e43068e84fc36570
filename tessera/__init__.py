"""Spatial-graph and walk-sequence analytics on Spark, with operators for training data in tessera.llm."""
