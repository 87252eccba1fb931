"""Training-data operators: packing, token output, deduplication, scoring, search and filtering.

Nothing outside this subpackage imports it.  ``queries`` lists the registered
queries; each operator lives in a module of its own with a general interface.
"""
