"""Training-data operators: each module is one operator with its own interface.

Nothing outside this package imports it; ``catalog`` binds the operators to the
driver's tables.
"""
