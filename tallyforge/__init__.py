"""Evidence analytics on Spark: every stage is a DataFrame in, DataFrame out function."""
