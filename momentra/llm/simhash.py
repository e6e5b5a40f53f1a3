"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has `words` 64-bit words. Fingerprints that may be near share the bits of at least one mask; rows are
dealt by (mask, bits) and sorted, and inside a task the fingerprints lie as vertical bit planes: plane j holds bit j of
64 rows a machine word. One shift of the planes compares every row with the one `d` places on at once; carry-save
adders count differing bits and words of rows that have all exceeded the radius are abandoned.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentra.llm.common import ASCII_LOWER, cut, release_memory, shuffle_parts
from momentra.llm.components import connected_components

#: Rows of one key that one task compares; a key with more is split into pairs of blocks.
BLOCK_ROWS = 20_000
#: The share of ids (1 in so many) that shows which keys are so large. It only steers the split, never the result.
HINT = 16
#: Of positions (i, j) of rows, which pairs pass.
PairTest = Callable[[np.ndarray, np.ndarray], np.ndarray]


# fingerprints ---------------------------------------------------------------------------------------------------

def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle of the A-Z lower-cased text; all words as one if there are fewer."""
    found = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    begin, end = (end - size)[: 1 - k or None].tolist(), end[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(begin, end)], np.uint64)


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """A further 64 bits from each hash (splitmix64); word 0 is the hash itself."""
    if not word:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15 * word % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def majority(h: np.ndarray, words: int) -> list[int]:
    """The fingerprint's words: a bit is 1 if set in over half the hashes; no hash gives zero."""
    out = []
    for w in range(words):
        count = np.zeros(64, np.int64)
        for at in range(0, len(h), 65_536):
            bits = np.unpackbits(_mixed(h[at : at + 65_536], w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count += bits.sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * count > len(h), bitorder="little").view(np.int64)[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, w0, w1, ...): the fingerprint's words as longs. Null and wordless texts give zeros.

    Python sees the texts alone, so ids of any size stay as they are.
    """
    cols = [f"w{i}" for i in range(words)]

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [majority(shingle_hashes(t, shingle), words) for t in texts]
        return pd.DataFrame(np.array(rows, np.int64).reshape(-1, words), columns=cols)

    made = F.pandas_udf(run, ", ".join(f"{c} long" for c in cols))(F.col("text").cast("string"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), made.alias("f")).select("doc_id", "f.*")


def fingerprint_hex(words: int) -> Column:
    """The fingerprint as lower-case hex, last word first."""
    return F.lower(F.concat(*[F.lpad(F.hex(f"w{i}"), 16, "0") for i in reversed(range(words))]))


# masks ----------------------------------------------------------------------------------------------------------

def pigeonhole_masks(radius: int, extra: int = 2) -> list[list[int]]:
    """64-bit masks of `extra` of radius + extra parts: with at most `radius` differing bits one is free of them."""
    cuts = np.array_split(np.arange(64), radius + extra)
    return [[sum(1 << int(b) for i in pick for b in cuts[i])] for pick in itertools.combinations(range(radius + extra), extra)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


# comparison -----------------------------------------------------------------------------------------------------

def bit_planes(fp: np.ndarray) -> np.ndarray:
    """fp uint64 (n, words) -> planes uint64 (64 * words, ceil(n / 64) + 1): bit i of plane j is bit j of row i."""
    n, words = fp.shape
    rows = np.zeros((-(-n // 64) * 64, words), np.uint64)
    rows[:n] = fp
    bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    return np.concatenate([packed, np.zeros((len(packed), 1), np.uint64)], axis=1)


def within(planes: np.ndarray, d: int, alive: np.ndarray, radius: int) -> np.ndarray:
    """Of the rows marked in `alive` (bits, one word per 64 rows), those within `radius` bits of the row d places on.

    Three planes at a time go through a carry-save adder; the counter starts so that its overflow means "over the
    radius". After each step only words with a live row are kept.
    """
    high, low = d // 64, np.uint64(d % 64)
    at = np.flatnonzero(alive)
    live = alive[at]
    size = radius.bit_length() or 1
    start = (1 << size) - 1 - radius
    full = np.uint64(2**64 - 1)
    count = [np.full(len(at), full if start >> k & 1 else 0, np.uint64) for k in range(size)]
    last = planes.shape[1] - 1
    first, second = np.minimum(at + high, last), np.minimum(at + high + 1, last)
    for j in range(0, len(planes), 3):
        diff = []
        for p in planes[j : j + 3]:
            other = p[first] if not low else (p[first] >> low) | (p[second] << (np.uint64(64) - low))
            diff.append(p[at] ^ other)
        a, b, c = [*diff, *[np.zeros(len(at), np.uint64)] * (3 - len(diff))]
        half = a ^ b
        ones, twos = half ^ c, (a & b) | (half & c)
        for level, carry in ((0, ones), (1, twos)):
            for k in range(level, size):
                count[k], carry = count[k] ^ carry, count[k] & carry
            live = live & ~carry
        keep = live != 0
        if not keep.all():
            if not keep.any():
                return np.zeros_like(alive)
            at, live, first, second, count = at[keep], live[keep], first[keep], second[keep], [x[keep] for x in count]
    out = np.zeros_like(alive)
    out[at] = live
    return out


def spanning_links(
    key: np.ndarray, fp: np.ndarray, radius: int, root: np.ndarray | None = None, every: bool = False, before: PairTest | None = None, after: PairTest | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key -> positions (i, j) of near rows of one key that connect all near rows of it.

    A pair already connected is not compared again, so a group of copies gives about as many links as it has rows.
    root: the first place of those rows of the key that are connected from the start. every: all near pairs not connected
    from the start, none passed over. before: which pairs are compared at all. after: which near pairs count.
    """
    n = len(key)
    planes, root = bit_planes(fp), np.arange(n) if root is None else root.copy()
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    rows_of = np.diff(np.r_[begin, n])
    left = np.repeat(begin + rows_of, rows_of) - 1 - np.arange(n)  # rows of the key that follow
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows = np.flatnonzero(left > 0)
    d = 1
    while len(rows):
        test = rows[root[rows] != root[rows + d]]
        if before and len(test):
            test = test[before(test, test + d)]
        if len(test):
            marks = np.zeros((planes.shape[1] - 1) * 64, bool)
            marks[test] = True
            near = within(planes, d, np.packbits(marks, bitorder="little").view(np.uint64), radius)
            hit = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
            if after and len(hit):
                hit = hit[after(hit, hit + d)]
            if len(hit) and not every:
                links = []
                for i in hit.tolist():
                    a, b = i, i + d
                    while root[a] != a:
                        a = root[a]
                    while root[b] != b:
                        b = root[b]
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        links.append(i)
                while (root != root[root]).any():
                    root = root[root]
                hit = np.array(links, np.int64)
            if len(hit):
                found.append((hit, hit + d))
        d += 1
        rows = rows[left[rows] >= d]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def hot_keys(dealt: DataFrame) -> DataFrame | None:
    """(key, n_blocks) of the keys of over BLOCK_ROWS rows of dealt (key, id, ...), about; None if there is none."""
    hint = dealt.where(F.pmod(F.xxhash64("id"), F.lit(HINT)) == 0).groupBy("key").count()
    hot = cut(hint.where(F.col("count") > BLOCK_ROWS // HINT).select("key", F.ceil(F.col("count") * HINT * 2 / BLOCK_ROWS).cast("int").alias("n_blocks")))
    n = hot.count()
    return None if not n else F.broadcast(hot) if n <= 100_000 else hot


def in_blocks(dealt: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of hot keys, with key replaced by pairs of blocks: any two rows of a key meet."""
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("n_blocks"))
    pair = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    x = dealt.join(hot, "key").select("*", F.explode(pair).alias("_block"))
    return x.drop("n_blocks", "key").withColumnRenamed("_block", "key")


LINKS = "a long, b long, origin long"


def block_links(
    dealt: DataFrame, words: int, radius: int, every: bool = False, more: list[str] | None = None, tests: Callable[[pd.DataFrame], tuple[PairTest, PairTest]] | None = None
) -> DataFrame:
    """dealt (key, id, comp, w0, ..., more) -> (a, b, origin): links between near rows of one key (origin) and different comp;
    spanning ones, or every one. tests makes the tests before and after a comparison from rows with the columns `more`.
    The rows of a key of over BLOCK_ROWS rows are dealt anew to pairs of blocks."""
    cols = [f"w{i}" for i in range(words)]
    rows = dealt.select("key", F.col("key").alias("origin"), "id", "comp", *cols, *(more or []))

    def links(x: pd.DataFrame) -> pd.DataFrame:
        key, origin, comp, ids = (x[c].to_numpy() for c in ("key", "origin", "comp", "id"))
        begin = np.r_[True, (key[1:] != key[:-1]) | (comp[1:] != comp[:-1])]
        root = np.flatnonzero(begin)[np.cumsum(begin) - 1]
        fp = np.ascontiguousarray(x[cols].to_numpy()).view(np.uint64).reshape(len(x), words)
        i, j = spanning_links(key, fp, radius, root, every, *(tests(x) if tests else ()))
        return pd.DataFrame({"a": ids[i], "b": ids[j], "origin": origin[i]})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= 2 * BLOCK_ROWS:
                x = pd.concat(held, ignore_index=True)
                key = x["key"].to_numpy()
                whole = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if whole:
                    yield links(x[:whole])
                held = [x[whole:]]
        if held:
            yield links(pd.concat(held, ignore_index=True))
        held.clear()
        release_memory()

    def through(x: DataFrame) -> DataFrame:
        return x.repartition(shuffle_parts(dealt.sparkSession), "key").sortWithinPartitions("key", "comp", "id").mapInPandas(run, LINKS)

    hot = hot_keys(dealt)
    if hot is None:
        return through(rows)
    return through(rows.join(hot, "key", "left_anti")).unionAll(through(in_blocks(rows, hot).select(*rows.columns)))


def near_links(reps: DataFrame, words: int, radius: int, masks: list[list[int]]) -> DataFrame:
    """reps (id, w0, ...), distinct fingerprints -> (a, b): links that connect all within `radius` sharing a mask's bits."""
    cols = [f"w{i}" for i in range(words)]
    keys = [F.xxhash64(F.lit(i), *[F.col(c).bitwiseAND(F.lit(_signed(m))) for c, m in zip(cols, mask) if m]) for i, mask in enumerate(masks)]
    dealt = reps.select("id", F.col("id").alias("comp"), *cols, F.explode(F.array(*keys)).alias("key"))
    return block_links(dealt, words, radius).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 3, words: int = 1, radius: int = 3) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, w0.., component_id): the least doc_id reachable over links of <= radius bits.

    One row per row of docs; rows with one doc_id share its component only through their fingerprints. Fingerprints are
    linked, not ids: a row without an id links and bridges as any other, but names its component only if no row of it
    has an id; component_id is null then. Copies meet as one fingerprint before anything is compared. The search
    is exact (pigeonhole masks). Further columns of docs are not looked at; an empty table gives an empty one; texts of
    any length are read whole.
    """
    cols = [f"w{i}" for i in range(words)]
    fps = cut(fingerprints(docs, shingle, words))
    reps = cut(fps.groupBy(*cols).agg(F.min("doc_id").alias("doc_id")).withColumn("id", F.monotonically_increasing_id()))
    comp = connected_components(near_links(reps.select("id", *cols), words, radius, pigeonhole_masks(radius)))
    named = cut(reps.join(comp, reps["id"] == comp["node"], "left").withColumn("c", F.coalesce("component", "id")))
    least = cut(named.groupBy("c").agg(F.min("doc_id").alias("component_id")))
    found = named.join(least, "c").select(*[F.col(c).alias(f"r_{c}") for c in cols], "component_id")
    return fps.join(found, [F.col(c) == F.col(f"r_{c}") for c in cols], "left").select("doc_id", *cols, "component_id")
