"""quillon: a PySpark-native engine for paired evaluation studies."""
