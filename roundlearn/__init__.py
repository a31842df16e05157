"""roundlearn: labelled-table analytics on Spark.

Label dictionaries, exact hash splits and stratified caps, text/vector
featurisation, round-incremental centroid heads, score fusion and
classification metrics, all expressed as DataFrame / SQL operations.
"""

__version__ = "0.1.0"
