"""Training-data operators: near-dedup, token counts, packing, filters, archives.

Every module holds one operator with its own general interface; ``queries``
derives the registered queries from them. Nothing else in the library imports
this package.
"""
