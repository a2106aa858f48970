"""corpuslens: Spark-native code and documentation search.

Scan project trees into tables, extract code and documentation structure,
chunk and embed text, build exact nearest-vector and call-graph tables, and
answer batches of questions -- all as DataFrame plans.
"""

__version__ = "0.1.0"
