"""Names of generated columns."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from .columns import column

# Fixed value: the name pattern of generated row ids, stripped on export.
GENERATED_ID = re.compile(r"^__tablewarden_row_id_[0-9a-f]{12}__$")


def new_id_name(taken: Sequence[str]) -> str:
    """A row id name that no column of the table has (names compare without case)."""
    used = {name.lower() for name in taken}
    while True:
        name = f"__tablewarden_row_id_{uuid.uuid4().hex[:12]}__"
        if name not in used:
            return name


def drop_generated_ids(df: DataFrame) -> DataFrame:
    """The table without generated row ids; user columns of a similar name stay."""
    kept = [c for c in df.columns if not GENERATED_ID.match(c)]
    return df if len(kept) == len(df.columns) else df.select(*[column(c) for c in kept])
