"""foliant: a PySpark-native engine that scores document transcriptions at scale."""
