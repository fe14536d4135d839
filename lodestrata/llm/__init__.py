"""Operations of a training-data pipeline: sharding, mixing, scoring, deduplication, filtering and vector search.

Nothing outside this subpackage imports it, except the guarded registration in ``__spark_entry__``.
"""
