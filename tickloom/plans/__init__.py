"""Plans of the bar-series library."""
