"""Progressive shaping of messy, semi-structured data on Spark."""
