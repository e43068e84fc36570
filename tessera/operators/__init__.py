"""Part of the spatial-graph engine."""
