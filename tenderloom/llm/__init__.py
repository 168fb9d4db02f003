"""Operators for building language-model training corpora on Spark.

Self-contained: nothing outside this folder imports it.  Every operator takes
a DataFrame of documents and returns a DataFrame; ``queries`` binds them to the
registered ``opN_<name>`` queries.
"""
