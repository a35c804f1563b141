"""Spark-native analytics for study corpora, question banks and retrieval evaluation."""
