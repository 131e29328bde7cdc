"""Training-data operators: one module per operator, thin queries in ``queries``.

Nothing outside this folder imports it.
"""
