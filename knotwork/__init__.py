"""Link analysis on Spark: evidence-graded graphs as DataFrames.

Nothing here imports the ``llm`` subpackage; it is an optional part for
training-data work.
"""
