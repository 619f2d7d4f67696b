"""Snapshots as streams."""
