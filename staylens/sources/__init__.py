"""Sources: typed reads (S1), previews and profiles (S2, S3), stand-in tables."""

from .preview import column_count, column_names, head_rows, profile, tail_rows
from .tables import MISSING_TOKENS, read_table, typed, write_table

__all__ = ["MISSING_TOKENS", "column_count", "column_names", "head_rows", "profile",
           "read_table", "tail_rows", "typed", "write_table"]
