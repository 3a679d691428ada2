"""Spark-native engine for preparing and auditing paired text/image corpora."""
