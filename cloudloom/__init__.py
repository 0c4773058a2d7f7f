"""cloudloom: a PySpark-native analytics engine for splat and point tables.

Layout: ``functions`` (pure Column -> Column expressions), ``operators``
(DataFrame -> DataFrame), ``sources`` (binary and text formats), ``plans``
(sizing, lineage and session helpers), ``streaming`` (Structured Streaming
forms), ``queries`` (named queries and their SQL twins) and the optional
subpackage ``llm``, which nothing else imports.
"""

__version__ = "0.1.0"
