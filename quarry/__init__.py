"""quarry: retrieval analytics over document knowledge bases, on Spark.

Documents and their embedding vectors live in per-user datasets. Whole
tables of queries are answered at once by exact vector distance (top-k,
or as many documents as fit a word budget); results become prompts for
batch model inference, and citations in replies are turned back into
links. Everything is DataFrame / Spark SQL; models plug in as callables.
"""

__version__ = "0.1.0"
