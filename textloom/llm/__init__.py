"""Operators of a large-scale training-data pipeline over ``documents``.

One module an operator, plus ``queries`` (the registered ``opN_*`` queries and
their SQL). Nothing outside this folder imports it.
"""
