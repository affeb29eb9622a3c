"""A PySpark-native engine for versioned, hierarchical texts: ingest, retrieval, evidence and activity."""
