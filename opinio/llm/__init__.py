"""Operators of a training-data pipeline over document, page and chat tables.

One module per operator; ``queries`` registers them over the driver tables.
Nothing outside this subpackage imports it (except the repository's entry file
and ``corpus_pipeline.py``, both of which work on top of it).
"""
