"""voxpop: passenger / customer feedback analytics on Spark DataFrames.

Stages: tolerant ingestion -> batch scoring (demand level, sentiment, factors)
-> distributions and evaluation -> factor mining -> vector clustering (exact
distributed Ward, silhouette-chosen cut) -> cluster naming -> theme network.
"""

__version__ = "0.1.0"
