"""A PySpark-native engine for panel (date x entity) analytics and cross-sectional research."""
