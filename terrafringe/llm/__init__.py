"""Training-data operators: packing, language id, near-duplicates, filters, sharding.

Nothing else in the library imports this subpackage.
"""
