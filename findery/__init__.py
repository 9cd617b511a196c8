"""Metadata search and large-scale text preparation on Spark."""
