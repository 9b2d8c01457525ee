"""Operators of the bar-series library."""
