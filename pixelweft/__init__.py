"""A PySpark-native engine for gridded sensor data: rasters as DataFrames, operators as lazy plans."""
