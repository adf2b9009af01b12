"""Vedette: a PySpark-native engine for observer coresets and the queries on them."""
