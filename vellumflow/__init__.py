"""Archive analytics on Spark: relational reports, entity resolution and corpus preparation."""
