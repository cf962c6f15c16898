"""A versioned object catalog and its queries on Spark."""
