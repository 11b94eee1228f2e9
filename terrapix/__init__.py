"""Spark operators for gridded land and energy tables."""
