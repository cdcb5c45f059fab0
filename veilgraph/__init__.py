"""Graph-preserving pseudonymization as Spark DataFrame stages."""
