"""skein: a PySpark-native analytics engine for evidence-backed, text-heavy records."""
