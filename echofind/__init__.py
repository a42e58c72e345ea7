"""Find likely duplicate text reports with Spark DataFrames.

The package is split by role:

``functions``  column expressions and vectorised helpers
``sources``    CSV, JSONL and table reading and writing
``operators``  validation, normalisation, nearest neighbours, evaluation
``plans``      whole flows put together from the operators
``streaming``  the same flows over Structured Streaming
"""
