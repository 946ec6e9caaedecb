"""Spark-native analytics for symbolic music and audio-derived time series."""
