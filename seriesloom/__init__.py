"""seriesloom: Spark-native analytics over irregular multi-channel time series."""
