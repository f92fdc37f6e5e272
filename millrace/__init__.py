"""Spark-native compaction and analysis of command output."""
