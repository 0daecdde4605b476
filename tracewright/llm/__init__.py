"""Training-data operators: thirteen corpus-scale components and their registered queries.

Nothing outside this subpackage imports it.
"""
