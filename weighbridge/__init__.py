"""Weighbridge: a PySpark-native engine for judging and summarising model responses at scale."""
