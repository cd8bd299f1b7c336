"""Analytics over saved runs of speech systems, on Spark."""
