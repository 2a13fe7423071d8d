"""Operators that prepare text corpora for language-model training.

Nothing else in the library imports this subpackage; ``queries.py`` registers
its queries and SQL for ``__spark_entry__.py``.
"""
