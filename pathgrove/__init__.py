"""Snapshot analytics over hierarchical file metadata, as Spark DataFrame queries."""
