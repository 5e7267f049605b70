"""Quernstone: a PySpark-native engine for building and querying a document knowledge base."""
