"""ratingloom: recommendation, search and analytics operators written as Spark DataFrame jobs."""
