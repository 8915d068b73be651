"""Map-reduce over tables and over outer products of ranges, on Spark."""
