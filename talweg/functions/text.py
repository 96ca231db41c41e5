"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Letters of Latin-1, Latin Extended-A and B and Extended Additional that are one base letter and marks, and those base letters."""
    found = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, x[0]) for c, x in found if len(x) > 1 and all(map(unicodedata.combining, x[1:]))]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BASE = _accents()


def fold(c: Column) -> Column:
    """Without accents: letters with marks become their base letters, one for one, and combining marks are left out (positions after them move)."""
    return F.regexp_replace(F.translate(c, ACCENTED, BASE), "[̀-ͯ]", "")


def squashed(c: Column) -> Column:
    """Every run of anything but A-Z and digits as one blank; blanks that stand alone are passed over, not put in again."""
    return F.regexp_replace(c, " [^A-Z0-9]+|[^A-Z0-9 ][^A-Z0-9]*", " ")
