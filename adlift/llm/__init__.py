"""Operators of a training-data pipeline.

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries (``adlift.llm.queries``) when it is present.
"""
