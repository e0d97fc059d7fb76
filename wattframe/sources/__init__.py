"""Distributed parsers for landing files.

Readers give one row per file (``path``, ``value``); parsers turn that frame into
table rows, so the same parser serves files, a stream, or text made in Spark.
"""
