"""Spark-native analytics layers: every operator is a function from DataFrame to DataFrame."""
