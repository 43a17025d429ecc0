"""Operations of a training-data pipeline: deduplication, search, tokens, packing, filters.

Nothing outside this package imports it.
"""
