"""Success-rate analytics on Spark: counts per site in, estimates and decisions out."""
