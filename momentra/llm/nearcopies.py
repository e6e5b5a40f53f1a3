"""SimHash near-dedup with an exact check: word-shingle Jaccard similarity of MIN_NUM / MIN_DEN or more.

SimHash fingerprints of the shingle sets are compared bit-sliced inside blocks, as in simhash; the pairs that lie within
the radius are then checked shingle by shingle. Blocks are keyed by shingles: with one order of all shingles, those that
many texts hold at the end, two similar sets share one among the first n - ceil(t n) + 1 of each, so no similar pair is
kept apart by the blocks. What the radius loses is a matter of the fingerprint's bits (RADIUS).

Two bounds that lose nothing keep pairs below the similarity from being linked. At the first key that two similar sets
share, neither has so many shingles before it that the rest can't hold their overlap. And the parities of the number of
shingles in each of some buckets differ in no more buckets than the sets differ in shingles.

Links that connect each block's near rows are checked first, so a large group of copies gives few links; blocks in which
one fails are then compared pair by pair. A wrong link can't hide a right one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentra.llm.common import cut, let_go, packed, release_memory
from momentra.llm.components import connected_components
from momentra.llm.simhash import PairTest, block_links, hot_keys, majority, shingle_hashes

#: Least similarity of near copies.
MIN_NUM, MIN_DEN = 4, 5
#: The share of texts (1 in so many) that shows which shingles are frequent, the least count there and the most
#: shingles so marked. They only set the order, never the result.
HINT, HINT_COUNT, HINT_ROWS = 16, 4, 200_000
#: Words of a fingerprint and the radius within which pairs are checked. Two sets of similarity 0.8 differ in 19 of 128
#: bits on average with a deviation of 4 (small sets: in 24 at most), so fewer than 1 in 1000 lie beyond 38 bits.
WORDS, RADIUS = 2, 38
#: Words of the shingle parities: a bit for each bucket of shingles.
PARITY = 4
#: Keys of each set by which large groups are connected before all keys are used.
FIRST = 3
#: Bits of the map of text hashes by which texts that no pair needs are left out before they are shuffled.
MAP_BITS = 1 << 26


SIGNATURE = [f"w{i}" for i in range(WORDS)] + [f"p{i}" for i in range(PARITY)]


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, k))


def prefix_size(n: int) -> int:
    return n - -(-MIN_NUM * n // MIN_DEN) + 1 if n else 0


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * MIN_DEN >= MIN_NUM * (len(a) + len(b) - both)


def parities(s: np.ndarray) -> np.ndarray:
    """Bit j: whether an odd number of the shingles lies in bucket j."""
    odd = np.bincount((s % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def bounds(x: pd.DataFrame) -> tuple[PairTest, PairTest]:
    """Rows (n, pos, p0, ...), pos being the key's place in the set -> the tests of positions (i, j) before and after the
    fingerprints are compared. Both pass every similar pair at the first key that it shares."""
    n, left = x["n"].to_numpy(np.int64), (x["n"] - x["pos"]).to_numpy(np.int64)
    odd = np.ascontiguousarray(x[[f"p{i}" for i in range(PARITY)]].to_numpy()).view(np.uint64)

    def before(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.minimum(left[i], left[j]) * (MIN_NUM + MIN_DEN) >= MIN_NUM * (n[i] + n[j])

    def after(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64)
        return apart * (MIN_NUM + MIN_DEN) <= (MIN_DEN - MIN_NUM) * (n[i] + n[j])

    return before, after


def frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a sample of the texts, sorted, and their counts in it."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, k).view(np.int64) for t in texts])

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(HINT)) == 0).distinct()
    count = some.select(F.explode(F.pandas_udf(run, "array<long>")(F.col("text"))).alias("h")).groupBy("h").count().where(F.col("count") >= HINT_COUNT)
    rows = count.orderBy(F.desc("count"), "h").limit(HINT_ROWS).collect()
    key = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], np.array([r["count"] for r in rows], np.int64)[order]


def prefixes(docs: DataFrame, k: int) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, text_hash, id, n, keys, w0, ..., p0, ...): id is a hash of the shingle set, n its size,
    keys its prefix, w0.. its fingerprint, p0.. its parities."""
    hot = docs.sparkSession.sparkContext.broadcast(frequent(docs, k))

    def run(texts: pd.Series) -> pd.DataFrame:
        often, count = hot.value
        out = []
        for t in texts:
            s = shingle_set(t, k)
            rank = np.zeros(len(s), np.int64)
            if len(often) and len(s):
                at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                rank = np.where(often[at] == s, count[at], 0)
            first = s[np.lexsort((s, rank))[: prefix_size(len(s))]]
            out.append((np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 7)).astype(np.int64), len(s), first.view(np.int64), *majority(s, WORDS), *parities(s)))
        release_memory()
        return pd.DataFrame(out, columns=["id", "n", "keys", *SIGNATURE])

    made = F.pandas_udf(run, "id long, n int, keys array<long>, " + ", ".join(f"{c} long" for c in SIGNATURE))(F.col("text"))
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), made.alias("s")).select("doc_id", "text_hash", "s.*")


def _listed(rows: DataFrame, col: str) -> Callable[[Column], Column]:
    """A test that every value of rows' long column passes, and few others."""
    slot = F.pmod(F.col(col), F.lit(MAP_BITS)) + 1
    parts = rows.groupBy(F.bitmap_bucket_number(slot).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    held = np.zeros((MAP_BITS >> 15, 1 << 12), np.uint8)
    for r in parts:
        held[r["at"] - 1] = np.frombuffer(r["bits"], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(held.reshape(-1))

    def run(values: pd.Series) -> pd.Series:
        at = values.to_numpy() % MAP_BITS
        return pd.Series((shared.value[at >> 3] >> (at & 7) & 1).astype(bool))

    return F.pandas_udf(run, "boolean")


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """Of pairs (a, b) those whose shingle sets are similar. reps: (id, doc_id, text_hash), one row for each set."""
    pairs = cut(pairs)
    n = pairs.count()
    pairs = packed(pairs, n)
    used = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    rows = packed(cut(reps.join(used, "id", "left_semi").select("id", F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"))), 2 * n)

    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        whole = lru_cache(256)(lambda t: shingle_set(t, k))
        found = pd.Series([similar(whole(x), whole(y)) for x, y in zip(a, b)], dtype=bool)
        whole.cache_clear()
        release_memory()
        return found

    some = docs.where(_listed(rows, "_t")(F.xxhash64("text")))
    texts = cut(some.join(rows, some["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(some["text"]) == F.col("_t"))).select("id", "text").dropDuplicates(["id"]))
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    found = cut(both.where(F.pandas_udf(same, "boolean")(F.col("ta"), F.col("tb"))).select("a", "b"))
    let_go(docs.sparkSession)
    return packed(found, n)


def shared_keys(prints: DataFrame) -> DataFrame:
    """prints (id, keys, ...) -> (id, pos, key) of the keys that several sets hold. Only keys with few rows are counted in one
    place; those with many, by a share of the ids, are shared anyhow."""
    keyed = prints.select("id", F.posexplode("keys").alias("pos", "key"))
    hot = hot_keys(keyed)
    cold = keyed if hot is None else keyed.join(hot, "key", "left_anti")
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    found = cold.withColumn("_n", n).where("_n > 1").select("id", "pos", "key")
    return found if hot is None else found.unionAll(keyed.join(hot, "key", "left_semi").select("id", "pos", "key"))


def near(rows: DataFrame, every: bool = False) -> DataFrame:
    """rows (key, id, comp, n, pos, w0, ..., p0, ...) -> (a, b, origin), a < b: links that may be of similar sets."""
    found = block_links(rows, WORDS, RADIUS, every, ["n", "pos", *SIGNATURE[WORDS:]], bounds)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "origin")


def components(docs: DataFrame, prints: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """prints (id, n, keys, w0, ..., p0, ...); reps (id, doc_id, text_hash) -> (node, component) of all ids linked by similar pairs.

    First a few keys of each set connect the large groups, at a few links a set; then all keys, where only blocks of
    different groups are left; then, pair by pair, the blocks in which a connecting link has failed its check. Signatures
    go only with keys that several sets hold.
    """
    rows = cut(cut(shared_keys(prints)).join(prints.select("id", "n", *SIGNATURE), "id"))

    def grouped(x: DataFrame) -> DataFrame:
        group = connected_components(good).withColumnRenamed("node", "id")
        return x.join(group, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")

    tried = cut(near(rows.where(F.col("pos") < FIRST).withColumn("comp", F.col("id"))).select("a", "b").distinct())
    good = verified(tried, docs, reps, k)
    keyed = cut(grouped(rows))
    mixed = keyed.groupBy("key").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a != _b")
    apart = cut(keyed.join(mixed, "key", "left_semi"))
    found = cut(near(apart))
    links = cut(found.select("a", "b").distinct())
    right = verified(links.join(tried, ["a", "b"], "left_anti"), docs, reps, k)
    good = cut(good.unionAll(right))
    again = cut(found.join(right, ["a", "b"], "left_anti").select(F.col("origin").alias("key")).distinct())
    if not again.count():
        return connected_components(good)
    rest = near(cut(grouped(apart.drop("comp").join(again, "key", "left_semi"))), every=True).select("a", "b").distinct()
    rest = rest.join(tried.unionAll(links), ["a", "b"], "left_anti")
    return connected_components(good.unionAll(verified(rest, docs, reps, k)))


def survivors(docs: DataFrame, k: int) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, text_hash), one row for each group of near copies.

    Groups are the components over pairs of similar texts, found by fingerprint and checked exactly. The least doc_id stays, null ids last, and of rows with
    one doc_id that of the least hash. Texts without a word are copies of each other.
    """
    docs = docs.select("doc_id", "text")
    rows = cut(prefixes(docs, k))
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = cut(rows.groupBy("id").agg(F.min(best).alias("row")))
    one = rows.groupBy("id").agg(F.min(F.struct("n", "keys", *SIGNATURE)).alias("s"))
    prints = cut(one.select("id", "s.n", "s.keys", *[f"s.{c}" for c in SIGNATURE]))
    comp = components(docs, prints, first.select("id", "row.doc_id", "row.text_hash"), k)
    named = first.join(comp, first["id"] == comp["node"], "left").groupBy(F.coalesce("component", "id").alias("c")).agg(F.min("row").alias("row"))
    return named.select("row.doc_id", "row.text_hash")
