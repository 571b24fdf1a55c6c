"""Spark-native prose analytics: Markdown to segments, sentences and diagnostics."""
