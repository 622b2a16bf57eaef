"""Spatial and text analytics as Spark DataFrame operators."""
