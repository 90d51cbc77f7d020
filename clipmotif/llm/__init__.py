"""Training-data operators: mixing, decontamination, deduplication, quality, secrets, HTML and WARC.

Every operator is a function from DataFrames to a DataFrame.  ``queries`` wires them to the
synthetic tables; nothing outside this subpackage imports it.
"""
