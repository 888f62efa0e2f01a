"""Image-catalogue search, matching, tagging and reporting as PySpark plans."""
