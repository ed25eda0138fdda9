"""Operators of a training-data pipeline; nothing else in the library imports them.

Texts are taken whole, null texts count as empty, and results cover every row.
Tables that are read more than once are written to ``spark.checkpoint.dir``.
"""
