"""A PySpark-native engine for screening and scoring documents."""
