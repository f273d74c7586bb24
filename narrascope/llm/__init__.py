"""Training-data operators: ten corpus-preparation steps built on Spark.

Nothing outside this package imports it; its queries are in ``llm.queries``.
"""
