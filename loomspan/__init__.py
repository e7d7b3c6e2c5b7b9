"""loomspan: a Spark-first engine for crawled-document stores.

Sub-packages: ``functions`` (column functions), ``operators`` (DataFrame operators),
``sources`` (readers and writers), ``plans`` (composed queries and their SQL oracles),
``streaming`` (Structured Streaming ingestion) and the optional ``llm`` (training data).
"""
