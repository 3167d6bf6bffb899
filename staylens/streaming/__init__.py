"""Streaming form of the daily vacancy ratio (A4) over calendar files.

The original analysis reads its files once and has no streams, watermarks or
state of its own; this module only lets the same per-date share run
incrementally when calendar snapshots arrive as new files in a folder. The
aggregation state is one (sum, count) pair per date, so it stays bounded by
the number of dates.
"""

from .vacancy import daily_vacancy_stream, start_daily_vacancy

__all__ = ["daily_vacancy_stream", "start_daily_vacancy"]
