"""PySpark-native engine for building, cleaning and evaluating corpora of scholarly metadata and text."""
