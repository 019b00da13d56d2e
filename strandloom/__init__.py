"""A PySpark-native engine for de Bruijn graph construction and unitig assembly."""
