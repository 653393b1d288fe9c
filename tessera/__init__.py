"""Spark-native analytics over wide annotation tables and the knowledge graphs built from them."""
