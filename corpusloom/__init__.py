"""Set-wise structural document processing on Spark."""
