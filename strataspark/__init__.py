"""A PySpark-native engine for panoramic borehole imagery, and for text data at large scale."""
