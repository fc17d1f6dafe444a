"""Training-data operators: dedup, packing, scoring, filtering and archives, each over whole Spark tables.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
