"""Greedy selections as one sorted pass: a key's rows come in order through a task, which keeps only what it has accepted.

Exact for keys of any size: no rows are left out, and no key's rows are held together.
"""

from __future__ import annotations

import bisect
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a task gives on at once.
BATCH = 10_000


class Greedy:
    """The state of one key. feed takes its rows in order; what feed and close give are rows of the result."""

    def feed(self, row: tuple) -> Iterable[tuple]:
        raise TypeError(f"{type(self).__name__} takes no rows")

    def close(self) -> Iterable[tuple]:
        return ()


def sorted_pass(df: DataFrame, order: list[str | Column], schema: str, make: Callable[[], Greedy], spread: bool = False) -> DataFrame:
    """df, whose first column is the key, through a state of make() for each key, a key's rows by order. spread: small data
    as well go to as many tasks as shuffles have partitions, for states that take long over a row."""
    key = df.columns[0]
    parts = [int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if spread else []
    rows = df.repartition(*parts, key).sortWithinPartitions(key, *order)
    return passed(rows, schema, make)


def passed(rows: DataFrame, schema: str, make: Callable[[], Greedy]) -> DataFrame:
    """sorted_pass over rows that are partitioned by the key, their first column, and sorted by it and the order."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def given(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * len(arrow), arrow)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, out = None, None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or row[0] != last:
                    if state is not None:
                        out.extend(state.close())
                    state, last = make(), row[0]
                out.extend(state.feed(row))
                if len(out) >= BATCH:
                    yield given(out)
                    out = []
        if state is not None:
            out.extend(state.close())
        yield given(out)

    return rows.mapInArrow(run, schema)


class Apart(Greedy):
    """Rows (key, id, t, score, k), best first -> (key, id, t, score, rank, relaxed): those at least gap from all accepted, k at
    most; with top_off the best others fill up. Holds 2 k rows at most."""

    def __init__(self, gap: float, top_off: bool) -> None:
        self.gap, self.top_off = gap, top_off
        self.kept: list[tuple] = []
        self.rest: list[tuple] = []
        self.k = 0

    def feed(self, row: tuple) -> Iterable[tuple]:
        *_, t, _, self.k = row
        if len(self.kept) < self.k and not (t is not None and any(r[2] is not None and abs(r[2] - t) < self.gap for r in self.kept)):
            self.kept.append(row)
        elif len(self.rest) < self.k:
            self.rest.append(row)
        return ()

    def close(self) -> Iterable[tuple]:
        more = self.rest[: max(0, self.k - len(self.kept))] if self.top_off else []
        for rank, (row, relaxed) in enumerate([*((r, False) for r in self.kept), *((r, True) for r in more)], 1):
            yield (*row[:4], rank, relaxed)


class Disjoint(Greedy):
    """Rows (key, id, lo, hi, score, t), best first, -> without t, those that overlap none kept before; touching is apart."""

    def __init__(self) -> None:
        self.lo: list[float] = []
        self.hi: list[float] = []

    def feed(self, row: tuple) -> Iterable[tuple]:
        *_, lo, hi, _, _ = row
        at = bisect.bisect_right(self.hi, lo)  # kept windows are apart, so both lists are sorted
        if at < len(self.lo) and self.lo[at] < hi:
            return ()
        self.lo.insert(at, lo)
        self.hi.insert(at, hi)
        return (row[:-1],)


#: Hashes up to which all are compared, rather than those that share a band.
FEW_HASHES = 2048


class Band:
    """One band's value: the hashes that have it and their places, in order."""

    __slots__ = ("hashes", "places")

    def __init__(self) -> None:
        self.hashes, self.places = array("Q"), array("q")

    def first_near(self, h: int, threshold: int, begin: int) -> int | None:
        old = bisect.bisect_left(self.places, begin) if begin else 0
        if 2 * old > len(self.places):
            del self.hashes[:old], self.places[:old]
            old = 0
        near = np.bitwise_count(np.frombuffer(self.hashes, np.uint64)[old:] ^ np.uint64(h)) <= threshold if len(self.places) > old else np.zeros(0, bool)
        at = int(near.argmax()) if len(near) else 0
        return self.places[old + at] if len(near) and near[at] else None


class Hashes:
    """64-bit hashes in order, and which of them (the last `horizon`) is the first within threshold bits of another.

    Two hashes within threshold bits agree in one of threshold + 1 bands of bits, so beyond FEW_HASHES only hashes that
    share a band are compared. Places before the horizon are let go.
    """

    def __init__(self, threshold: int, horizon: int | None = None) -> None:
        self.threshold, self.horizon, self.n = threshold, horizon, 0
        cuts = [round(i * 64 / (threshold + 1)) for i in range(threshold + 2)]
        self.bands = [(lo, (1 << hi - lo) - 1) for lo, hi in zip(cuts, cuts[1:])] if threshold < 64 else []
        self.all, self.tables = Band(), None

    def values(self, h: int) -> list[int]:
        return [h >> lo & mask for lo, mask in self.bands]

    def first_near(self, h: int) -> int | None:
        h &= 2**64 - 1
        begin = 0 if self.horizon is None else max(0, self.n - self.horizon)
        if self.tables is None:
            return self.all.first_near(h, self.threshold, begin)
        shared = [t[v] for t, v in zip(self.tables, self.values(h)) if v in t]
        whole = next((b for b in shared if len(b.places) >= self.n - begin), None)  # a band that doesn't vary shows all
        found = [at for b in ([whole] if whole else shared) if (at := b.first_near(h, self.threshold, begin)) is not None]
        return min(found, default=None)

    def add(self, h: int) -> None:
        h &= 2**64 - 1
        if self.tables is None:
            self.all.hashes.append(h)
            self.all.places.append(self.n)
            if len(self.all.places) > FEW_HASHES and self.bands:
                self.tables = [{} for _ in self.bands]
                for at, old in zip(self.all.places, self.all.hashes):
                    self._file(at, old)
                self.all = Band()
        else:
            self._file(self.n, h)
        self.n += 1

    def _file(self, at: int, h: int) -> None:
        for t, v in zip(self.tables, self.values(h)):
            b = t.get(v)
            if b is None:
                b = t[v] = Band()
            b.hashes.append(h)
            b.places.append(at)


class UnlikeBits(Greedy):
    """Rows (key, id, h, t) in time order -> (key, id) of those over threshold bits from all kept (the last `horizon`); null h is kept."""

    def __init__(self, threshold: int, horizon: int | None) -> None:
        self.kept = Hashes(threshold, horizon)

    def feed(self, row: tuple) -> Iterable[tuple]:
        key, i, h, *_ = row
        if h is None:
            return ((key, i),)
        if self.kept.first_near(h) is not None:
            return ()
        self.kept.add(h)
        return ((key, i),)


class Clusters(Greedy):
    """Rows (key, id, h, t) in time order -> (key, id, cluster): the first head within threshold, else a new one; null h is alone."""

    def __init__(self, threshold: int) -> None:
        self.heads, self.ids = Hashes(threshold), []

    def feed(self, row: tuple) -> Iterable[tuple]:
        key, i, h, *_ = row
        if h is None:
            return ((key, i, i),)
        at = self.heads.first_near(h)
        if at is None:
            at = self.heads.n
            self.heads.add(h)
            self.ids.append(i)
        return ((key, i, self.ids[at]),)


class UnlikeTokens(Greedy):
    """Rows (key, ..., tokens) in order -> those whose Jaccard similarity to all kept is below limit, without tokens, and a
    place; up to k, where the best others then fill up. Without k nothing fills up."""

    def __init__(self, limit: float, k: int | None = None) -> None:
        self.limit, self.k = limit, k
        self.kept: list[frozenset] = []
        self.rest: list[tuple] = []

    def like(self, a: frozenset, b: frozenset) -> bool:
        either = len(a | b)
        return (len(a & b) / either if either else 0.0) >= self.limit

    def feed(self, row: tuple) -> Iterable[tuple]:
        tokens = frozenset(row[-1] or ())
        full = self.k is not None and len(self.kept) >= self.k
        if not full and not any(self.like(tokens, x) for x in self.kept):
            self.kept.append(tokens)
            return ((*row[:-1], len(self.kept)),)
        if self.k is not None and len(self.rest) < self.k:
            self.rest.append(row[:-1])
        return ()

    def close(self) -> Iterable[tuple]:
        if self.k is not None:
            for place, row in enumerate(self.rest[: max(0, self.k - len(self.kept))], len(self.kept) + 1):
                yield (*row, place)
