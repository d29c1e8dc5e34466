"""Spark-native entity blocking engine: text keys, capped joins, profiles and evaluation."""
