"""Training-data operators: each module holds one operator with its own general interface.

``queries`` registers the thin ``opN_<name>`` queries over the driver tables.
Nothing outside this package imports it, but for the entry module (which
leaves it out when the package is absent) and ``corpus_pipeline``.
"""
