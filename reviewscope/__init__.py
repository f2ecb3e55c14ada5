"""Review analytics on Spark: cleaning, credibility, aspects, topics, emotions."""
