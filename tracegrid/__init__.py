"""tracegrid: a Spark-native engine for segmented grid files and symbol streams."""
