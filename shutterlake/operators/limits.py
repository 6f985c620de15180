"""Guards for lists that users type by hand and that plans may hold as literals."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: No hand-made list (exclusions, chosen people, months) is longer.
MOST_LISTED = 1000


def small_list(df: DataFrame, column: str) -> list:
    """Values of a column of a hand-made list; a longer one is refused rather than cut."""
    rows = df.select(column).distinct().orderBy(column).limit(MOST_LISTED + 1).collect()
    if len(rows) > MOST_LISTED:
        raise ValueError(f"{column}: more than {MOST_LISTED} values; join them instead")
    return [r[0] for r in rows]
