"""Training-data operators: packing, filtering, scanning, deduplication, sharding and language identification.

Nothing else in the library imports this subpackage.
"""
