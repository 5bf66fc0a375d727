"""Spark-native engine for datasets of identity-ordered quadrilaterals."""
