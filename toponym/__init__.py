"""Versioned address-gazetteer analytics, recognised-text post-processing and training-data operators on Spark."""
