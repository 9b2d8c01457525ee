"""Sources of the bar-series library."""
