"""callgauge: Spark-native evaluation of generated web-API requests."""
