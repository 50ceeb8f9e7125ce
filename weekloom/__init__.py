"""DataFrame operators for preparing, segmenting and evaluating business time series on Spark."""
