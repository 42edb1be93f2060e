"""Log analytics on Spark: parsing, issue grouping and trend queries as DataFrame jobs."""
