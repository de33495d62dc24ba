"""Analytics over region-of-interest signals and behaviour events, and training-data jobs, on Spark."""
