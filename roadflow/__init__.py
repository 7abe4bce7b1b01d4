"""roadflow: a PySpark-native analytics engine for vehicle-trajectory data."""
