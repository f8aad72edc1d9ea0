"""Spark-native document retrieval, analytics and evaluation."""
