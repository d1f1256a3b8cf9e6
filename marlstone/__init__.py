"""marlstone: a PySpark-native engine for content catalogues and activity heat."""
