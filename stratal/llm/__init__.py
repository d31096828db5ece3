"""Training-data operators: text identification, joins, encodings, scoring.

Nothing else in ``stratal`` imports this subpackage, and importing it loads no
operator, so a Python worker pays only for the module it runs.
"""
