"""Bar-series research on Spark: DataFrame-to-DataFrame operators for interval data."""
