"""Spark-native analytics for evaluating language-model outputs at scale."""
