"""Removing byte spans from texts: shared by the two substring deduplicators."""

from __future__ import annotations

import hashlib

import numpy as np


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans; touching spans are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    at = np.flatnonzero(first)
    return starts[at], ends[np.concatenate([at[1:] - 1, [len(ends) - 1]])]


def without(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """raw less the merged spans."""
    if not len(starts):
        return raw
    cuts = [0, *np.stack([starts, ends], 1).reshape(-1).tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def digest_row(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans, kept_sha256."""
    return len(raw), int((ends - starts).sum()), len(starts), hashlib.sha256(without(raw, starts, ends)).hexdigest()
