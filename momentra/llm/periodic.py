"""Periodic runs of words: stretches that repeat a cycle of q words at least four times (six words at least).

Recursive frequency splitting: each word of a run occurs TIMES times in it at least, so a word that is rarer in a segment
lies in no run there and splits the segment; the parts are counted anew until nothing splits. What survives is scanned by
lag. Lags of 2^k to 2^(k+1) - 1 are scanned together: blocks of 2^k words are numbered exactly, each aligned block is
held against those that begin in the next one, and a run shows as the same lag at two aligned blocks in a row at least.
So a segment of m words costs m log m, whatever its lags.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A run has max(LEAST, TIMES * period) words or more.
LEAST, TIMES = 6, 4
#: Words of texts that are worked on together; a longer text is alone. Memory is about 4 log2(m) bytes a word of the longest segment.
CHUNK_WORDS = 300_000

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])


def words_of(text: str | None) -> list[bytes]:
    """Words between blanks (space, tab to carriage return)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def frequent_segments(ids: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids, numbers of words; seg, their texts in order -> begin and end of the segments no word splits any more."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    pos, most = np.arange(len(ids)), int(ids.max(initial=0)) + 1
    while len(pos):
        _, at, n = np.unique(seg * most + ids[pos], return_inverse=True, return_counts=True)
        stays = n[at] >= TIMES
        split = np.zeros(int(seg[-1]) + 1, bool)
        split[seg[~stays]] = True
        again = split[seg[stays]]  # parts of segments that have lost a word are counted anew
        pos, seg = pos[stays], seg[stays]
        first = np.flatnonzero(np.r_[True, (np.diff(pos) != 1) | (np.diff(seg) != 0)][: len(pos)])
        size = np.diff(np.r_[first, len(pos)])
        first, size = first[long := size >= LEAST], size[long]
        stable = ~again[first]
        done.append((pos[first[stable]], pos[first[stable]] + size[stable]))
        first, size = first[~stable], size[~stable]
        place = np.r_[0, np.cumsum(size)]
        pos, seg = np.repeat(pos[first] - place[:-1], size) + np.arange(place[-1]), np.repeat(np.arange(len(first)), size)
    return tuple(np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in (0, 1))


def common_length(blocks: list[np.ndarray], i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
    """Words from i and j on (or before them) that are equal, less than twice the longest block."""
    got = np.zeros(len(i), np.int64)
    for k in reversed(range(len(blocks))):
        size, names = 1 << k, blocks[k]
        a, b = (i + got, j + got) if forward else (i - got - size, j - got - size)
        inside = (np.minimum(a, b) >= 0) & (np.maximum(a, b) < len(names))
        same = inside & (names[np.where(inside, a, 0)] == names[np.where(inside, b, 0)])
        got += same * size
    return got


def lag_scan(ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The runs within the segments [begin, end) of ids, as rows (start, length, period)."""
    order = np.argsort(begin - end, kind="stable")  # long segments first: a lag needs only those of four times its words
    begin, size = begin[order], (end - begin)[order]
    place = np.r_[0, np.cumsum(size + 1)]  # one word that is like no other ends each segment
    x = np.zeros(place[-1], np.int64)
    inner = np.repeat(begin - place[:-1], size + 1) + np.arange(len(x))
    x[:] = ids[np.minimum(inner, len(ids) - 1)]
    x[place[1:] - 1] = int(ids.max(initial=0)) + 1 + np.arange(len(size))
    blocks, found, k = [np.unique(x, return_inverse=True)[1].astype(np.int32)], [], 0
    while (b := 1 << k) * TIMES <= (size[0] if len(size) else 0):
        n = place[np.searchsorted(-size, -TIMES * b, side="right")]
        names = blocks[k][: n - b + 1]
        rows = -(-n // b)
        grid = np.full(rows * b, -1, np.int32)
        grid[: len(names)] = names
        grid = grid.reshape(rows, b)
        same = (grid[1:] == grid[:-1, :1]) & (grid[:-1, :1] >= 0)
        row, col = np.nonzero(same[:-1] & same[1:] if len(same) > 1 else np.zeros((0, b), bool))
        row, col = row[s := np.lexsort((row, col))], col[s]
        head = np.flatnonzero(np.r_[True, (np.diff(row) != 1) | (np.diff(col) != 0)][: len(row)])
        lo, lag = row[head] * b, col[head] + b
        hi = (row[np.r_[head[1:] - 1, len(row) - 1][: len(head)]] + 2) * b
        lo = lo - common_length(blocks[: k + 1], lo, lo + lag, False)
        hi = hi + common_length(blocks[: k + 1], hi, hi + lag, True)
        length = hi - lo + lag
        good = length >= np.maximum(LEAST, TIMES * lag)
        found.append(np.stack([lo[good], length[good], lag[good]], 1))
        k += 1
        if n >= 2 * b:
            pairs = names[: n - 2 * b + 1].astype(np.int64) << 32 | names[b : n - b + 1]
            blocks.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
    out = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    out = out[np.r_[True, (np.diff(out[:, 0]) != 0) | (np.diff(out[:, 1]) != 0)][: len(out)]]  # of one stretch's lags the least
    at = np.searchsorted(place, out[:, 0], side="right") - 1
    out[:, 0] += (begin - place[:-1])[at] if len(out) else 0
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each text, a list of words, its runs (start, length, period) by start and period."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64)
    place = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
    runs = lag_scan(ids, *frequent_segments(ids, np.repeat(np.arange(len(texts)), np.diff(place))))
    cut = np.searchsorted(runs[:, 0], place)
    return [runs[a:b] - [p, 0, 0] for a, b, p in zip(cut, cut[1:], place)]


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words but those that a run holds after its first cycle."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(w for w, k in zip(words, keep) if k).decode("utf-8", "surrogatepass")


def find_runs(docs: DataFrame, rewrite: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_words, runs, collapsed), one row a row of docs.

    runs: all maximal stretches of smallest period q that have max(6, 4 q) words or more, by start and period; collapsed:
    the words that are kept when each run keeps only its first cycle, with one space between. rewrite(words, doc_id) may
    change a text's words first. Nothing is shuffled. A null or empty text has no words, no runs and an empty collapsed
    text; repeated rows and null ids are rows like others; runs that tie or overlap are all given; very long texts are
    worked on alone; an empty table gives an empty one; further columns are left out, whatever their names.
    """

    def told(ids: list[int | None], texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of(texts)
        rows = [[{"start": a, "length": n, "period": q} for a, n, q in r.tolist()] for r in runs]
        cols = [ids, [len(t) for t in texts], rows, [collapsed(t, r) for t, r in zip(texts, runs)]]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, ARROW)], schema=ARROW)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, n = [], [], 0
            for i, text in zip(b.column(0), b.column(1)):
                words = words_of(text.as_py())
                words = rewrite(words, i.as_py()) if rewrite else words
                if texts and n + len(words) > CHUNK_WORDS:
                    yield told(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(i.as_py())
                texts.append(words)
                n += len(words)
            if texts:
                yield told(ids, texts)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
