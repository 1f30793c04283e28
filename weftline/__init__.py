"""weftline: a Spark-native engine for record linkage and corpus processing."""
