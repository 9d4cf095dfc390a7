"""String normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _col

# Runs of letters and runs of non-letters; every letter run is capitalised,
# which is Python's str.title (initcap alone only splits on blanks).
_RUNS = r"(\P{L}+|\p{L}+)"


def title_case(c) -> Column:
    """strip + title-case after any non-letter ('ri-bhoi' -> 'Ri-Bhoi')."""
    s = F.lower(F.regexp_replace(_col(c).cast("string"), r"^\s+|\s+$", ""))
    runs = F.regexp_extract_all(s, F.lit(_RUNS), 1)
    cased = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30)))
    return F.when(s.isNotNull(), F.array_join(cased, ""))
