"""lodestrata: a Spark-first engine for code-retrieval corpora.

Subpackages: ``functions`` (Column builders), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and sinks), ``plans`` (composed pipelines and
the query registry), ``streaming`` (incremental ingestion).
"""

__version__ = "0.1.0"
