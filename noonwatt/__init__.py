"""Day-ahead energy analytics as Spark DataFrame transformations."""
