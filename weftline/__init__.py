"""Spark-native evidence analytics: baskets, interactions, enrichment, similarity, graphs, retrieval, dose."""
