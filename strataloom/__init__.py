"""strataloom: corpus and code analytics on Spark DataFrames.

Subpackages: ``operators`` (data-generic transformations), ``functions`` (column expressions), ``sources`` (scans and
sinks), ``plans`` (composed queries and the query registry), ``streaming`` (incremental forms) and ``llm`` (operators
for training-data pipelines; nothing else in the library depends on it).
"""

__version__ = "0.1.0"
