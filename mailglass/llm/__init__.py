"""Operations for large-scale training-data preparation, as Spark jobs.

Nothing outside this subpackage imports it.
"""
