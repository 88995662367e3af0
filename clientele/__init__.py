"""Customer-relationship analytics as Spark DataFrame operators.

Every operator takes DataFrames and an explicit ``as_of`` time and returns a
lazy DataFrame; only model training and the writers run jobs.
"""
