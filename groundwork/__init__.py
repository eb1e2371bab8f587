"""Spark-native groundwater-quality analytics."""
