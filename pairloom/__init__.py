"""Exact embedding similarity and retrieval evaluation on Spark."""
