"""A Spark-native reconciliation engine: two records of the same activity, and why they differ."""

VERSION = "0.1.0"
