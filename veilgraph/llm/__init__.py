"""Operators that a large training-data pipeline needs. Nothing else in veilgraph imports this package."""
