"""Word errors: substitutions, deletions and insertions of a hypothesis against a reference."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERRORS = T.StructType([T.StructField(c, T.IntegerType()) for c in "csdi"])


def errors(reference: Sequence[str], hypothesis: Sequence[str]) -> tuple[int, int, int, int]:
    """Total edits and their kinds.

    Equal words cost nothing; of equally good ways a substitution goes before a deletion, and that before an insertion. The
    programme runs over anti-diagonals, each one step in numpy. It keeps edits and substitutions only: the deletions less the
    insertions on the way to a cell are its row less its column.
    """
    n, m = len(reference), len(hypothesis)
    numbers: dict[str, int] = {}
    ref, hyp = (np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) for words in (reference, hypothesis))
    edits, subs = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)  # of the last diagonal, by row
    before = edits.copy(), subs.copy()
    for k in range(1, n + m + 1):
        new, new_subs = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        if k <= m:
            new[0] = k
        if k <= n:
            new[k] = k
        low, high = max(1, k - m), min(n, k - 1)
        if low <= high:
            at = slice(low, high + 1)
            up, left, diagonal = edits[low - 1 : high], edits[at], before[0][low - 1 : high]
            same = ref[low - 1 : high] == hyp[k - high - 1 : k - low][::-1]
            swap = ~same & (diagonal <= up) & (diagonal <= left)
            drop = ~same & ~swap & (up <= left)
            new[at] = np.where(same | swap, diagonal, np.where(drop, up, left)) + ~same
            new_subs[at] = np.where(same | swap, before[1][low - 1 : high] + swap, np.where(drop, subs[low - 1 : high], subs[at]))
        before, edits, subs = (edits, subs), new, new_subs
    c, s = int(edits[n]), int(subs[n])
    return c, s, (c - s + n - m) // 2, (c - s - n + m) // 2


@F.pandas_udf(ERRORS)
def _errors(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    found = [(None,) * 4 if r is None or h is None else errors(list(r), list(h)) for r, h in zip(reference, hypothesis)]
    return pd.DataFrame(found, columns=list("csdi")).astype("Int32")


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """STRUCT<c, s, d, i> over two word arrays, of `errors`; null if either is. Equal arrays need no alignment."""
    none = F.array().cast("array<string>")
    equal = reference == hypothesis
    found = _errors(F.when(equal, none).otherwise(reference), F.when(equal, none).otherwise(hypothesis))
    return F.when(reference.isNotNull() & hypothesis.isNotNull(), found)


def rate(edits: Column, reference_words: Column) -> Column:
    """Edits a reference word; null without reference words."""
    return F.try_divide(edits.cast("double"), reference_words.cast("double"))
