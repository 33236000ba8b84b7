"""vitalspan: a PySpark-native analytics engine for personal health records."""
