"""Records from captured web pages, and how good they are, on Spark."""
