"""Training-data operators: text forms, overlap, splits, samples, mixing and pieces.

Nothing outside this subpackage imports it.  ``queries.queries()`` and
``oracle.oracle_sql()`` carry the pN_ entries for the driver.
"""
