"""Language-model scoring by context-tree weighting, beside a unigram base.

Bytes are decomposed into eight binary decisions. Every decision has a context tree whose nodes are byte contexts of
growing depth: no byte, the last one, the last two, and from a word's fourth byte on all bytes of the word so far, of any
length. A node's Krichevsky-Trofimov estimate is mixed with its subtrees' at every depth. The blank that ends a word is
one symbol to the tree; which blank it is has a code of its own.

Counts come from all training texts. The deepest nodes are as many as the corpus has distinct beginnings of words: they
are the counts of its distinct words, dealt by their first bytes, and each word's code length from its fourth byte on is
computed once, where its neighbours are. Documents then join the words' code lengths together with their counts. What
is broadcast has a bound: tables of the contexts of two bytes (65,536 at most) and HEAD words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentra.llm.common import ASCII_LOWER, crc_mod, cut, shuffle_parts

#: The byte that ends a text (UTF-8 has none such), and the symbol for the end of a word.
END, WORD_END = 255, 32
IS_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32, END))
#: What may end a word: six blanks or the text's end.
ENDINGS = 7
#: From so many bytes of a word on the context is the whole of them.
WHOLE = 3
#: A token of N / HEAD occurrences or more is looked up in a broadcast table: HEAD rows at most. The others are joined.
HEAD = 1_000_000
#: Distinct tokens that a task counts before it hands the counts on, and words that a task weighs at once.
FLUSH, WORDS = 300_000, 100_000
#: Words with one beginning that go into one task; more are split by two further bytes.
SPLIT_WORDS = 1_000_000


def lowered(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER) if text else b""


def token_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42) - (1 << 63)


#: The end token; no word has a blank.
END_HASH = token_hash(b" ")


def shallow_slots(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, and the end, that is not after WHOLE bytes of a word: (last byte, the one before, byte) as one number;
    and the bytes that end words."""
    b = np.frombuffer(raw + bytes([END]), np.uint8)
    blank = IS_BLANK[b]
    at = np.arange(len(b))
    last = np.maximum.accumulate(np.where(blank, at, -1))
    run = at - np.concatenate([[-1], last[:-1]]) - 1  # bytes of the word so far
    ends = blank & (run > 0)
    symbol = np.where(ends, WORD_END, b).astype(np.int64)
    before = np.concatenate([[0, 0], symbol[:-1]])
    slots = (before[1:] << 16) | (before[:-1] << 8) | symbol
    return slots[run < WHOLE], b[ends]


# estimates ------------------------------------------------------------------------------------------------------

def _bit_counts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n (..., 256) counts of bytes -> zeros and ones (..., 256) seen at each node of the byte's binary tree, by heap index."""
    zeros, ones = np.zeros_like(n), np.zeros_like(n)
    level = n
    for depth in range(7, -1, -1):
        pairs = level.reshape(*level.shape[:-1], -1, 2)
        zeros[..., 1 << depth : 2 << depth], ones[..., 1 << depth : 2 << depth] = pairs[..., 0], pairs[..., 1]
        level = pairs.sum(-1)
    return zeros, ones


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, seven steps up: within 1e-11 for x >= 0.5."""
    up = np.ones_like(x)
    for i in range(7):
        up = up * (x + i)
    z = x + 7
    r = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / z - np.log(up)


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The log of the Krichevsky-Trofimov estimate of a block of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - np.log(np.pi)


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b + 0.5) / (a + b + 1)


def _mixed(own: np.ndarray, deeper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logs of a node's own estimate and of its subtrees' product -> the log of the weighted estimate, the weight of its own."""
    total = np.logaddexp(own, deeper) - np.log(2)
    return total, np.exp(own - np.log(2) - total)


def byte_log10(one: np.ndarray) -> np.ndarray:
    """Probabilities of a one at each node (..., 256) -> log10 of the probability of each byte (..., 256)."""
    level = np.zeros((*one.shape[:-1], 1))
    for depth in range(8):
        p = one[..., 1 << depth : 2 << depth]
        level = np.stack([level + np.log10(1 - p), level + np.log10(p)], axis=-1).reshape(*one.shape[:-1], -1)
    return level


# words ----------------------------------------------------------------------------------------------------------

@dataclass
class Level:
    """The decisions after j bytes: rows are the words that go so far, nodes the distinct (beginning, symbol) of them."""

    rows: np.ndarray  # places of the words
    node: np.ndarray  # each row's node
    start: np.ndarray  # each node's beginning (a number that sorts) and
    symbol: np.ndarray  # symbol
    context: np.ndarray  # each node's last two bytes
    n: np.ndarray  # each node's count

    def decisions(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each of the eight: (first node, heap index, zeros, ones) of each distinct decision, and each node's decision and bit."""
        for t in range(8):
            key = (self.start << t) | (self.symbol >> (8 - t))  # nodes are sorted, so are these
            new = np.r_[True, key[1:] != key[:-1]]
            first = np.flatnonzero(new)
            bit = self.symbol >> (7 - t) & 1
            ones = np.add.reduceat(self.n * bit, first)
            yield first, (1 << t) | (self.symbol[first] >> (8 - t)), np.add.reduceat(self.n, first) - ones, ones, np.cumsum(new) - 1, bit


def word_levels(words: list[bytes], counts: np.ndarray, begin: int, end: int | None = None) -> Iterator[Level]:
    """The levels of words of `begin` bytes or more, from `begin` on, up to before `end`; words that share beginnings are together.

    A word that is cut at `end` has no symbol there.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    off = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
    _, start = np.unique(np.array([w[:begin] for w in words], object), return_inverse=True)
    rows, j = np.arange(len(words)), begin
    while len(rows) and (end is None or j < end):
        more = size[rows] > j
        symbol = np.where(more, buf[np.minimum(off[rows] + j, len(buf) - 1)], WORD_END)
        key, place, node = np.unique(start << 8 | symbol, return_index=True, return_inverse=True)
        at = off[rows[place]] + j
        yield Level(rows, node, key >> 8, key & 255, buf[at - 1] << 8 | buf[at - 2], np.bincount(node, counts[rows], len(key)))
        rows, start, j = rows[more], node[more], j + 1


def deep_evidence(words: list[bytes], counts: np.ndarray, begin: int, end: int | None) -> pd.DataFrame:
    """(slot, loge, a, b): for each decision in each context of two bytes, summed over the beginnings below it, the log of their
    estimates and their zeros and ones."""
    slots, values = [np.zeros(0, np.int64)], [np.zeros((3, 0))]
    for level in word_levels(words, counts, begin, end):
        for first, v, a, b, _, _ in level.decisions():
            slots.append(level.context[first] << 8 | v)
            values.append(np.stack([_log_kt(a, b), a, b]))
    key, at = np.unique(np.concatenate(slots), return_inverse=True)
    loge, a, b = (np.bincount(at, x, len(key)) for x in np.concatenate(values, axis=1))
    return pd.DataFrame({"slot": key, "loge": loge, "a": a, "b": b})


@dataclass
class Tables:
    """What the tasks share. row: of each context of two bytes; the others have a row for each that was seen, then one for
    each last byte, then the root's. p(bit) = stay + go * (the deeper node's estimate), or leaf where there is none. stay and
    leaf are kept for zero and for one: in 32 bits one minus a probability near 1 would be nothing."""

    row: np.ndarray
    stay: np.ndarray  # bit, row, heap index
    go: np.ndarray
    leaf: np.ndarray  # bit, row, heap index
    shallow: np.ndarray | None  # log10 of each byte's probability where no word's beginning counts
    ending: np.ndarray | None  # log10 of each ending's


def word_scores(words: list[bytes], counts: np.ndarray, begin: int, end: int | None, t: Tables) -> np.ndarray:
    """log10 of each word's probability from its byte `begin` on, up to before `end`."""
    out = np.zeros(len(words))
    for level in word_levels(words, counts, begin, end):
        log = np.zeros(len(level.n))
        row = t.row[level.context]
        for first, v, a, b, decision, bit in level.decisions():
            r = row[first]
            zero, one = (np.where(a + b > 0, t.stay[i, r, v] + t.go[r, v] * k, t.leaf[i, r, v]) for i, k in enumerate((_kt(b, a), _kt(a, b))))
            log += np.log10(np.where(bit > 0, one[decision], zero[decision]))
        out[level.rows] += log[level.node]
    return out


def dealt_words(words: DataFrame) -> list[tuple[DataFrame, int, int | None]]:
    """words (key, word, c) of WHOLE bytes or more -> (words with their beginning as `head`, from, before) parts of the tree.

    Words of one beginning go into one task; a beginning of over SPLIT_WORDS words is cut after two further bytes, where
    it has 65,792 forms at most, and its words are dealt anew by these. The parts' scores of a word add up.
    """
    parts, at, left = [], WHOLE, words
    while True:
        left = left.withColumn("head", F.substring("word", 1, at))
        sizes = left.groupBy("head").agg(F.count(F.lit(1)).alias("words"))
        hot = cut(sizes.where(F.col("words") > SPLIT_WORDS).select("head"))
        if not hot.count():
            return [*parts, (left, at, None)]
        parts.append((left.join(F.broadcast(hot), "head", "left_anti"), at, None))
        many = cut(left.join(F.broadcast(hot), "head", "left_semi"))
        parts.append((many, at, at + 2))
        left, at = many.where(F.octet_length("word") >= at + 2).drop("head"), at + 2


def through_words(part: tuple[DataFrame, int, int | None], run, schema: str) -> DataFrame:
    """run(keys, words, counts, begin, end) over runs of whole beginnings. Where the part ends at a byte, words that agree up to
    there go once, with their counts summed, and the key is that of the cut word."""
    words, begin, end = part
    if end is not None:
        words = words.groupBy("head", F.substring("word", 1, end).alias("cut")).agg(F.sum("c").alias("c")).select(
            "head", F.col("cut").alias("word"), F.xxhash64("cut").alias("key"), "c"
        )
    rows = words.select("head", "key", "word", "c").repartition(shuffle_parts(words.sparkSession), "head").sortWithinPartitions("head", "word")

    def given(x: pd.DataFrame) -> pd.DataFrame:
        return run(x["key"].to_numpy(), x["word"].tolist(), x["c"].to_numpy().astype(float), begin, end)

    def batches(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            held.append(f)
            if sum(map(len, held)) >= WORDS:
                x = pd.concat(held, ignore_index=True)
                whole = int((x["head"] != x["head"].iloc[-1]).sum())  # the last beginning may go on
                if whole:
                    yield given(x[:whole])
                held = [x[whole:]]
        if held:
            yield given(pd.concat(held, ignore_index=True))

    return rows.mapInPandas(batches, schema)


# corpus ---------------------------------------------------------------------------------------------------------

def corpus_counts(docs: DataFrame) -> DataFrame:
    """docs (text, learn) -> (kind, key, word, n): kind 0, bytes by shallow slot; 1, tokens by hash, each text's end among them;
    2, what ends words. Texts that aren't learned from give their tokens with 0."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        endings = np.zeros(256, np.int64)
        slots: list[np.ndarray] = []
        ends = held = 0

        def given(kind: int, key: np.ndarray, n: np.ndarray, word: list[bytes] | None = None) -> pd.DataFrame:
            return pd.DataFrame({"kind": np.full(len(key), kind, np.int32), "key": key, "word": pd.Series(word or [None] * len(key), dtype=object), "n": n})

        def tokens() -> pd.DataFrame:
            return given(1, np.fromiter(map(token_hash, seen), np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen)), list(seen))

        for batch in batches:
            for text, learn in zip(batch["text"], batch["learn"]):
                raw = lowered(text)
                if not learn:
                    for w in raw.split():
                        if w not in seen:
                            seen[w] = 0
                else:
                    shallow, after = shallow_slots(raw)
                    slots.append(shallow)
                    held += len(shallow)
                    endings += np.bincount(after, minlength=256)
                    seen.update(raw.split())
                    ends += 1
                if held > 2 << 20:
                    yield given(0, *np.unique(np.concatenate(slots), return_counts=True))
                    slots, held = [], 0
                if len(seen) > FLUSH:
                    yield tokens()
                    seen.clear()
        yield tokens()
        if slots:
            yield given(0, *np.unique(np.concatenate(slots), return_counts=True))
        yield given(1, np.array([END_HASH]), np.array([ends]), [b" "])
        yield given(2, np.arange(256), endings)

    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce("learn", F.lit(False)).alias("learn"))
    counted = rows.mapInPandas(run, "kind int, key long, word binary, n long").where("n > 0 or kind = 1")
    return counted.groupBy("kind", "key", "word").agg(F.sum("n").alias("n"))


def context_tables(counts: DataFrame) -> Tables:
    """The tables of corpus_counts. Each last byte's contexts, 256 at most, are weighted in a task of their own."""
    known = counts.where(F.col("kind") == 1).where((F.col("n") > 0) & (F.octet_length("word") >= WHOLE)).select("key", "word", F.col("n").alias("c"))
    shallow = counts.where(F.col("kind") == 0).select(F.col("key").alias("slot"), F.lit(0.0).alias("loge"), F.col("n").cast("double").alias("a"), F.lit(-1.0).alias("b"))
    evidence = lambda keys, words, c, begin, end: deep_evidence(words, c, begin, end)
    rows = shallow
    for part in dealt_words(known):
        rows = rows.unionAll(through_words(part, evidence, "slot long, loge double, a double, b double"))
    rows = rows.groupBy("slot", (F.col("b") < 0).alias("shallow")).agg(F.sum("loge").alias("loge"), F.sum("a").alias("a"), F.sum("b").alias("b"))

    def subtree(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        slot, flat = x["slot"].to_numpy(), x["shallow"].to_numpy(bool)
        context, row = np.unique(slot >> 8, return_inverse=True)
        n, loge, a, b = (np.zeros((len(context), 256)) for _ in range(4))
        n[row[flat], slot[flat] & 255] = x["a"].to_numpy()[flat]
        for table, c in ((loge, "loge"), (a, "a"), (b, "b")):
            table[row[~flat], slot[~flat] & 255] = x[c].to_numpy()[~flat]
        zeros, ones = _bit_counts(n)
        a, b = a + zeros, b + ones
        total, stay2 = _mixed(_log_kt(a, b), _log_kt(zeros, ones) + loge)
        a1, b1 = a.sum(0), b.sum(0)
        total1, stay1 = _mixed(_log_kt(a1, b1), total.sum(0))
        single = np.stack([total1, a1, b1, stay1]).tobytes()
        return pd.DataFrame(
            {
                "last": [int(key[0])], "single": [single], "context": [context.tobytes()],
                "double": [np.stack([stay2, _kt(a, b), _kt(zeros, ones)]).tobytes()],
            }
        )

    found = rows.groupBy(F.shiftright("slot", 16).alias("last")).applyInPandas(subtree, "last long, single binary, context binary, double binary").collect()
    singles = {r["last"]: np.frombuffer(bytes(r["single"])).reshape(4, 256) for r in found}
    a0, b0 = (sum((x[i] for x in singles.values()), np.zeros(256)) for i in (1, 2))
    _, stay0 = _mixed(_log_kt(a0, b0), sum((x[0] for x in singles.values()), np.zeros(256)))
    root, contexts = _kt(a0, b0), [np.frombuffer(bytes(r["context"]), np.int64) for r in found]
    seen = np.concatenate([np.zeros(0, np.int64), *contexts])
    size = len(seen) + len(found) + 1
    row = np.full(1 << 16, size - 1, np.int32)
    stay, leaf = (np.zeros((2, size, 256), np.float32) for _ in range(2))
    go, shallow = (np.zeros((size, 256), np.float32) for _ in range(2))
    sides = lambda one: np.stack([1 - one, one])
    at = 0
    for i, r in enumerate(found):
        _, a1, b1, stay1 = singles[r["last"]]
        stay2, k2, none = np.frombuffer(bytes(r["double"])).reshape(3, -1, 256)
        upper, down = stay0 * sides(root) + (1 - stay0) * stay1 * sides(_kt(a1, b1)), (1 - stay0) * (1 - stay1)
        here = slice(at, at + len(k2))
        stay[:, here], go[here] = upper[:, None] + down * stay2 * sides(k2), down * (1 - stay2)
        leaf[:, here] = upper[:, None] + down * sides(k2)
        shallow[here] = byte_log10(upper[1] + down * (stay2 * k2 + (1 - stay2) * none))
        row[r["last"] << 8 : (r["last"] + 1) << 8] = len(seen) + i
        edge = stay0 * root + (1 - stay0) * _kt(a1, b1)
        stay[:, len(seen) + i] = leaf[:, len(seen) + i] = sides(edge)
        shallow[len(seen) + i] = byte_log10(edge)
        at = here.stop
    stay[:, -1] = leaf[:, -1] = sides(root)
    shallow[-1] = byte_log10(root)
    row[seen] = np.arange(len(seen))
    endings = np.zeros(256)
    for r in counts.where(F.col("kind") == 2).collect():
        endings[r["key"]] = r["n"]
    return Tables(row, stay, go, leaf, shallow, np.log10((endings + 0.5) / (endings.sum() + 0.5 * ENDINGS)))


def code_lengths(counts: DataFrame, tables: Tables) -> DataFrame:
    """corpus_counts -> (key, s): log10 of the probability of each token of WHOLE bytes or more from its byte WHOLE on."""
    shared = counts.sparkSession.sparkContext.broadcast(replace(tables, shallow=None, ending=None))
    words = counts.where(F.col("kind") == 1).where(F.octet_length("word") >= WHOLE).select("key", "word", F.col("n").alias("c"))

    def scored(keys: np.ndarray, found: list[bytes], c: np.ndarray, begin: int, end: int | None) -> pd.DataFrame:
        return pd.DataFrame({"key": keys, "s": word_scores(found, c, begin, end, shared.value)})

    parts = dealt_words(words)
    out = None
    for part in parts:
        s = through_words(part, scored, "key long, s double")
        if part[2] is not None:
            s = part[0].select("key", F.xxhash64(F.substring("word", 1, part[2])).alias("_cut")).join(s.withColumnRenamed("key", "_cut"), "_cut").select("key", "s")
        out = s if out is None else out.unionAll(s)
    return out if len(parts) == 1 else out.groupBy("key").agg(F.sum("s").alias("s"))


# scoring --------------------------------------------------------------------------------------------------------

def score_documents(docs: DataFrame, learn: Column) -> DataFrame:
    """docs (doc_id, text, ...) and learn, a condition on them -> one row a row of docs.

    (doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte): base_score sums log10((c + 1) / (N + V
    + 1)) over the tokens; score is the log10 probability that the context-tree model gives the lower-cased text and
    its end; bits_per_byte its code length by byte, the end counted. The model learns from the rows that meet the
    condition (null: not met). Null text is empty: the end alone. Tokens are counted by a 64-bit hash. With no training
    text all estimates are those of empty counts.
    """
    spark = docs.sparkSession
    counts = cut(corpus_counts(docs.select("text", learn.alias("learn"))))
    tables = context_tables(counts)
    plain = counts.where(F.col("kind") == 1).select("key", F.col("n").alias("c"))
    tokens = cut(plain.join(code_lengths(counts, tables), "key", "left").select("key", "c", F.coalesce("s", F.lit(0.0)).alias("s")))
    total = tokens.where("c > 0").agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, norm = total["n"], float(np.log10(total["n"] + total["v"] + 1))
    head = tokens.where((F.col("c") > 0) & (F.col("c") * F.lit(HEAD) >= F.lit(n))).orderBy("key").toPandas()
    known = dict(zip(head["key"].tolist(), zip(np.log10(head["c"] + 1).tolist(), head["s"].tolist())))
    shared = spark.sparkContext.broadcast((tables.row, tables.shallow, tables.ending, known))

    @F.pandas_udf("n_tokens long, base double, hit long, score double, bytes long, tail array<long>, times array<int>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        row, shallow, ending, known = shared.value
        number: dict[bytes, int] = {}
        for texts in batches:
            out = []
            for text in texts:
                raw = lowered(text)
                own = Counter(raw.split())
                slots, after = shallow_slots(raw)
                size, base, hit, tail, times = 0, 0.0, 0, [], []
                score = float(shallow[row[slots >> 8], slots & 255].sum(dtype=np.float64) + ending[after].sum())
                for word, k in [*own.items(), (b" ", 1)]:
                    h = number.get(word)
                    if h is None:
                        if len(number) > FLUSH:
                            number.clear()
                        h = number[word] = token_hash(word)
                    c = known.get(h)
                    if c is None:
                        tail.append(h)
                        times.append(k)
                    else:
                        base += k * c[0]
                        score += k * c[1]
                        hit += k
                    size += k
                out.append((size, base - size * norm, hit, score, len(raw) + 1, tail, times))
            yield pd.DataFrame(out, columns=["n_tokens", "base", "hit", "score", "bytes", "tail", "times"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scored(F.col("text").cast("string")).alias("x")).select("doc_id", "x.*")
    made = cut(made.withColumn("row", F.monotonically_increasing_id()))
    rare = made.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("key"), F.col("x.times").alias("k"))
    seen = F.col("c") > 0
    found = rare.join(tokens, "key").groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more"), F.sum(F.when(seen, F.col("k")).otherwise(0)).alias("more_hit"),
        F.sum(F.col("k") * F.col("s")).alias("more_score")
    )
    joined = made.drop("tail", "times").join(found, "row", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    bits = -F.col("score") / F.log10(F.lit(2.0)) / F.col("bytes")
    return joined.select(
        "doc_id", "n_tokens", (F.col("hit") + F.coalesce("more_hit", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", bits.alias("bits_per_byte")
    )


def training_part(doc_id: str = "doc_id", parts: int = 7, held: int = 2) -> Column:
    """The rows that a model learns from: crc32 of the id's text modulo `parts` is not `held`."""
    return crc_mod(F.col(doc_id), parts) != held
