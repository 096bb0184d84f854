"""ledgerlens: check what documents say against what data shows, on Spark.

Every public operator takes DataFrames and returns a DataFrame, so a batch of
many documents, questions, claims and metric tables runs as one Spark job.
"""

__version__ = "0.1.0"
