"""Spark-native analytics for photo-post catalogues and their images."""
