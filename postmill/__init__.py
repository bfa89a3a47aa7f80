"""postmill: finding, matching and tracking job postings at scale on Spark."""
