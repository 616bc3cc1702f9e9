"""Declarative, bidirectional mappings between quad datasets and nested trees, on Spark."""
