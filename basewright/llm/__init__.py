"""Operators of a training-data pipeline, each a Spark job over whole tables.

Nothing outside this package imports it.  ``queries`` has the driver's query
for each operator, and their SQL where SQL can express them.
"""
