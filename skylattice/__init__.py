"""Skylattice: a PySpark-native engine for moment retrieval and corpus work."""
