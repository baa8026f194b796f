"""Rows of a key in map state, packed into chunks by time.

Every call to the state store is a round trip, so a row or second of its own would cost one each. A chunk holds the rows of a span of time, a few
hundred of them, as packed numbers and one text of ids. The chunks of a key do not overlap. A micro-batch writes only the chunks whose rows it adds to,
changes or leaves behind; a chunk that grows is split between two seconds, so writes grow with the micro-batch and not with the state.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
from pyspark.sql import types as T

#: Rows of a chunk; one of more than twice as many is split.
CHUNK = 500

PART = T.StructType([T.StructField("part", T.LongType())])
PACKED = T.StructType([
    T.StructField("at", T.BinaryType()),
    T.StructField("units", T.BinaryType()),
    T.StructField("versions", T.BinaryType()),
    T.StructField("ids", T.StringType()),
])


class Rows(NamedTuple):
    """Rows of a key by time: seconds, whole numbers, versions, ids, and the chunk that each one lies in."""

    at: np.ndarray
    units: np.ndarray
    version: np.ndarray
    ids: np.ndarray
    part: np.ndarray

    def of(self, chosen: np.ndarray) -> Rows:
        return Rows(*(c[chosen] for c in self))


def _texts(ids: list) -> np.ndarray:
    out = np.empty(len(ids), dtype=object)
    out[:] = ids
    return out


def load(state) -> Rows:
    """All rows of the key's chunks, in time order."""
    chunks = [(np.frombuffer(v[0], np.int64), v, k[0]) for k, v in state.iterator()]
    if not chunks:
        empty = np.empty(0, np.int64)
        return Rows(empty, empty, np.empty(0, np.int32), _texts([]), empty)
    chunks.sort(key=lambda c: c[0][0])
    return Rows(
        np.concatenate([at for at, *_ in chunks]),
        np.concatenate([np.frombuffer(v[1], np.int64) for _, v, _ in chunks]),
        np.concatenate([np.frombuffer(v[2], np.int32) for _, v, _ in chunks]),
        _texts([name for _, v, _ in chunks for name in json.loads(v[3])]),
        np.repeat(np.array([part for *_, part in chunks], dtype=np.int64), [len(at) for at, *_ in chunks]),
    )


def added(held: Rows, at: list[int], units: list[int], version: list[int], ids: list) -> tuple[Rows, np.ndarray]:
    """(held and new rows in time order, which of them are new); a new row joins the chunk whose time it falls in or after."""
    t = np.array(at, dtype=np.int64)
    if len(held.at):
        opens = np.flatnonzero(np.append(True, held.part[1:] != held.part[:-1]))
        part = held.part[opens][np.maximum(np.searchsorted(held.at[opens], t, side="right") - 1, 0)]
    else:
        part = np.zeros(len(t), np.int64)
    fresh = Rows(t, np.array(units, dtype=np.int64), np.array(version, dtype=np.int32), _texts(ids), part)
    order = np.argsort(np.concatenate([held.at, t]), kind="stable")
    return Rows(*(np.concatenate(c)[order] for c in zip(held, fresh, strict=True))), order >= len(held.at)


def store(state, rows: Rows, stays: np.ndarray, touched: np.ndarray, stored: np.ndarray) -> None:
    """Write the chunks of touched rows, without rows that do not stay; chunks of which nothing stays go. ``stored``: the chunks there were."""
    kept = rows.of(stays)
    known = set(stored.tolist())
    last = max(known, default=0)
    for part in np.unique(rows.part[touched]).tolist():
        own = kept.of(kept.part == part)
        pieces = 1 if len(own.at) <= 2 * CHUNK else -(-len(own.at) // CHUNK)
        # Rows of one second stay together.
        cuts = np.searchsorted(own.at, own.at[[i * len(own.at) // pieces for i in range(1, pieces)]], side="left") if pieces > 1 else []
        edges = sorted({0, *(int(c) for c in cuts), len(own.at)})
        for a, b in zip(edges, edges[1:], strict=False):
            if a:
                last += 1
            value = own.at[a:b].tobytes(), own.units[a:b].tobytes(), own.version[a:b].tobytes(), json.dumps(own.ids[a:b].tolist())
            state.updateValue((part if a == 0 else last,), value)
    for part in known.difference(kept.part.tolist()):
        state.removeKey((part,))
