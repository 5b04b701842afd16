"""Dealing rows into ranges of doc_id with about equal numbers of rows: bounds from a scan of doc_id alone, a binary search for
a batch of rows at a time. A null doc_id comes before all others. A doc_id that fills several ranges by itself is parted by a
hash of the text, so that no range grows with it unless its rows are equal texts too."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST = -(1 << 63)


@dataclass
class Ranges:
    """Range i + 1 begins at (place[i], mark[i]), both ascending; range 0 holds what comes before all of them."""

    place: np.ndarray
    mark: np.ndarray

    def __len__(self) -> int:
        return len(self.place) + 1

    @property
    def parted(self) -> bool:
        """Whether a doc_id lies in several ranges."""
        return bool((self.mark != FIRST).any())

    def of(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The range of each row."""
        at = np.searchsorted(self.place, place, "right")
        if self.parted:
            low = np.searchsorted(self.place, place, "left")
            for i, j in np.unique(np.stack([low, at], 1)[at > low], axis=0).tolist():
                rows = (low == i) & (at == j)
                at[rows] = i + np.searchsorted(self.mark[i:j], mark[rows], "right")
        return at.astype(np.int32)


def ranges_of(docs: DataFrame, n: int) -> Ranges:
    """n ranges at most of docs, exact up to a rank error of a twentieth of a range."""
    cuts = docs.select(F.percentile_approx(F.coalesce("doc_id", F.lit(FIRST)), [i / n for i in range(n)], 20 * n).alias("q")).first().q or []
    place, mark = [], []
    for v, times in zip(*np.unique(np.array(cuts, np.int64), return_counts=True), strict=True):
        for j in range(int(times)):
            if j or v != cuts[0]:  # the least doc_id opens range 0
                place.append(int(v))
                mark.append(FIRST + (j << 64) // int(times))
    return Ranges(np.array(place, np.int64), np.array(mark, np.int64))


def placed(docs: DataFrame, ranges: Ranges) -> DataFrame:
    """doc_id, text, place, mark: the order of rows is that of place, then mark."""
    mark = F.xxhash64("text") if ranges.parted else F.lit(FIRST)
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(FIRST)).alias("place"), mark.cast("long").alias("mark"))
