"""Training-data pipeline operators: extraction, quality, dedup, mixing, sharding, packing, tokens.

Every module here stands alone: nothing else in the library imports this subpackage, and the
queries over the test tables live in :mod:`loomgraph.llm.queries`.
"""
