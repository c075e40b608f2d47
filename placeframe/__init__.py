"""Place-based listing analytics on Spark."""
