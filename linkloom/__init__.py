"""linkloom: finds, cleans, checks and reports links in page collections, as Spark DataFrame jobs."""
