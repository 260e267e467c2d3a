"""Spark-native engine for note collections: parsing, retrieval, graph, tasks, index upkeep and data cleaning."""
