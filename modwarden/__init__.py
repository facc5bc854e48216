"""Spark-native text moderation, mining and corpus preparation."""
