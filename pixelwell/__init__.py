"""Dense-array and feature analytics on the DataFrame API."""
