"""tillroll: subscription and in-app purchase revenue data on Spark.

Every operator takes and returns DataFrames; only the writers in `sources` and `plans` run jobs.
"""
