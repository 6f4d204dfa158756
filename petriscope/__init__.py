"""PySpark-native analytics over images, segmentations and their objects."""
