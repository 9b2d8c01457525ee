"""Functions of the bar-series library."""
