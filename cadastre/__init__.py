"""Land-survey and land-records analytics as Spark DataFrame operators."""
