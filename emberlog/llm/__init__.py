"""Training-data operators: scoring, filtering, de-duplication, sharding and packing.

Nothing else in the package imports this subpackage.
"""
