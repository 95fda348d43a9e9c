"""Training-data pipeline operators: quality, language, scoring, dedup, packing.

Nothing outside this package imports it; it may be deleted as a whole.
"""
