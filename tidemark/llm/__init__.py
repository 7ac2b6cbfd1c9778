"""Operators that prepare language-model training corpora with Spark.

Nothing outside this subpackage imports it.
"""
