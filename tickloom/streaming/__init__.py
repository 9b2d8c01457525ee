"""Streaming of the bar-series library."""
