"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(c: Column) -> Column:
    """Keep letters, digits, ``-`` and ``_``; lower; collapse repeats; trim both marks."""
    kept = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", ""))
    single = F.regexp_replace(F.regexp_replace(kept, "_+", "_"), "-+", "-")
    return F.btrim(single, F.lit("_-"))
