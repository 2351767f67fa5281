"""Source-code quality analytics on Spark.

Files in, issue rows, per-file metrics, run summaries and reports out; every
step is a DataFrame transformation, in batch and as a stream.
"""

__version__ = "0.1.0"
