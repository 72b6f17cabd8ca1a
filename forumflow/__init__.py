"""forumflow: Spark-native operators for discussion-forum datasets.

Sub-packages: ``functions`` (column expressions), ``sources`` (landed JSON,
HTML and multi-dataset scans), ``operators`` (dedup, capped assignment,
threads, media, members, top-k, enrichment), ``sinks`` (writers),
``plans`` (proof queries, their DuckDB oracle, the end-to-end build) and
``streaming`` (incremental landing).
"""

__version__ = "0.1.0"
