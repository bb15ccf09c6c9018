"""The queries over the star-schema tables."""
