"""The recording as a part of every key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def ids(*frames: DataFrame) -> list[str]:
    """``recording_id`` where all frames have it, so that rows of different recordings never meet; nothing for tables of one recording."""
    return [c for c in ("recording_id",) if all(c in f.columns for f in frames)]
