"""Training-data operators: one module per operator, queries in ``queries.py``.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; what a task needs beyond built-in functions runs on Arrow
batches, a document at a time.
"""
