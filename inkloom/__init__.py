"""Spark-native analytics for noisy OCR and translation text."""
