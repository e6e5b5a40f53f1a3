"""Spelling variants: words that differ by one letter, grouped under their most frequent form.

The words stand in a frequency-vector trie: level by level the count of one group of letters, a leaf being the words
with one vector. One inserted, deleted or replaced letter puts at most one letter more in one group and at most one less
in another, so a depth-first search goes to the children whose counts spend no more than a surplus and a deficit of one
each; the words of the leaves it reaches are then compared letter by letter.

The trie's top (the length and the first counts, more of them for more words) deals the words out to tasks: a word rests in the block of its own
top and visits those within the same budget. A block's resting words are held in lanes of LANE_ROWS words at most, the
visitors stream past them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentra.llm.common import ascii_lower, cut

#: Letters of a word: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
#: Groups of letters; a letter's group is its code point modulo GROUPS. The trie's levels take every fourth group in turn.
GROUPS = 32
LEVELS = [(1 + 4 * (j % 8) + j // 8) % GROUPS for j in range(GROUPS)]
#: Resting words that a task holds at once.
LANE_ROWS = 4096
#: Words of fewer letters are compared as rows of a matrix, about CHUNK pairs at once; longer ones one by one.
SHORT, CHUNK = 32, 50_000
#: Words below a node of the trie whose paths are followed together.
FEW = 16


def letter_runs(text: Column, least: int) -> Column:
    """The text's runs of letters of `least` or more code points, A-Z in lower case."""
    run = lambda w: F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(ascii_lower(w))
    return F.transform(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)), run)


def word_counts(words: DataFrame, min_letters: int = 5, min_count: int = 3) -> DataFrame:
    """words (word), one row an occurrence -> (word, n) of the words long and frequent enough; counted before they are shuffled."""
    return words.where(F.length("word") >= min_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def group_count(word: Column, group: int) -> Column:
    held = "".join(chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)] if c % GROUPS == group)
    return F.length(word) - F.length(F.translate(word, held, ""))


def _block(length: Column, counts: list[Column]) -> Column:
    return F.concat_ws(",", length, *counts)


def top_levels(words: int) -> int:
    """Levels of the trie that deal so many words out to tasks: one more for twice the words, so that blocks stay as large."""
    return min(GROUPS // 2, max(2, math.ceil(math.log2(max(1, words) / (16 * LANE_ROWS)))))


def dealt(vocab: DataFrame, top: int) -> DataFrame:
    """vocab (word, n) -> (block, lane, visits, word, n): each word once at rest, and once a lane of each block it visits.

    A pair of one length is looked for by the word of the smaller top, in one block by the greater word; of two lengths by
    the shorter word. So every pair meets once.
    """
    tops = [group_count(F.col("word"), LEVELS[j]).alias(f"c{j}") for j in range(top)]
    x = vocab.select("word", "n", F.length("word").alias("len"), *tops)
    c = [F.col(f"c{j}") for j in range(top)]
    plus = lambda up, down=None: [v + 1 if j == up else v - 1 if j == down else v for j, v in enumerate(c)]
    own = _block(F.col("len"), c)
    longer = [_block(F.col("len") + 1, plus(up)) for up in range(top + 1)]  # top: a group below the top
    # of two tops of one length the first count that differs is greater in the visited one
    same = [F.when(c[down] > 0, _block(F.col("len"), plus(up, down))) for up in range(top) for down in range(up + 1, top)]
    same += [_block(F.col("len"), plus(up)) for up in range(top)]
    rest = x.select(own.alias("block"), "word", "n")
    lanes = cut(rest.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / LANE_ROWS).cast("int").alias("lanes")))
    goes = x.select("word", "n", F.explode(F.filter(F.array(own, *longer, *same), lambda b: b.isNotNull())).alias("block"))
    visits = goes.join(lanes, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.lit(True).alias("visits"), "word", "n")
    rests = rest.join(lanes, "block").select("block", F.pmod(F.xxhash64("word"), "lanes").cast("int").alias("lane"), F.lit(False).alias("visits"), "word", "n")
    return rests.unionAll(visits)


def vectors(words: list[str]) -> np.ndarray:
    """Counts of the words' letter groups in the order of the trie's levels."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) % GROUPS
    out = np.bincount(np.repeat(np.arange(len(words)), size) * GROUPS + code, minlength=len(words) * GROUPS)
    return out.reshape(-1, GROUPS).astype(np.int32)[:, LEVELS]


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' first SHORT code points as rows that zeros fill up, and their lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    rows = "".join(w[:SHORT].ljust(SHORT, "\0") for w in words).encode("utf-32-le")
    return np.frombuffer(rows, np.uint32).reshape(-1, SHORT), size


def near_rows(a: np.ndarray, b: np.ndarray, same_size: np.ndarray) -> np.ndarray:
    """near for rows of letters under SHORT, where b is as long as a or one longer."""
    off = a != b
    first = off.argmax(1)
    shifted = np.c_[a[:, :-1] != b[:, 1:], a[:, -1] != 0]
    last = SHORT - 1 - shifted[:, ::-1].argmax(1)
    return np.where(same_size, off.sum(1) == 1, ~shifted.any(1) | (last < first))


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class Trie:
    """A frequency-vector trie over sorted vectors: a node is the range of the words that share its counts so far."""

    def __init__(self, words: list[str], top: int) -> None:
        self.top, v = top, vectors(words)
        order = np.lexsort(v.T[::-1])
        self.words, self.vectors = [words[i] for i in order], v[order]
        self.rows, self.size = letters(self.words)

    def search(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """wanted: vectors -> (rows of wanted, places of words) within the budget, each pair once, in pieces."""
        stack = [(0, len(self.words), 0, np.arange(len(wanted)), np.zeros(len(wanted), np.int32), np.zeros(len(wanted), np.int32))]
        while stack:
            begin, end, level, rows, surplus, deficit = stack.pop()
            if level == GROUPS:  # a leaf: all its words have the vector
                for at in range(0, len(rows), step := max(1, CHUNK // (end - begin))):
                    yield np.repeat(rows[at : at + step], end - begin), np.tile(np.arange(begin, end), len(rows[at : at + step]))
            elif end - begin <= FEW:  # the rest of a few words' paths at once
                off = self.vectors[None, begin:end, level:] - wanted[rows, None, level:]
                up = np.maximum(off, 0).sum(2)
                row, word = np.nonzero((surplus[:, None] + up <= 1) & (deficit[:, None] + up - off.sum(2) <= 1))
                yield rows[row], begin + word
            else:
                counts = self.vectors[begin:end, level]
                edges = [0, *(np.flatnonzero(counts[1:] != counts[:-1]) + 1).tolist(), end - begin]
                want = wanted[rows, level]
                for a, b in zip(edges, edges[1:]):
                    off = counts[a] - want
                    s, d = surplus + np.maximum(off, 0), deficit - np.minimum(off, 0)
                    ok = np.flatnonzero((s <= 1) & (d <= 1))
                    if len(ok):
                        stack.append((begin + a, begin + b, level + 1, rows[ok], s[ok], d[ok]))

    def candidates(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What search gives, in pieces of about CHUNK pairs."""
        held, n = [], 0
        for piece in self.search(wanted):
            held.append(piece)
            n += len(piece[0])
            if n >= CHUNK:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, n = [], 0
        if n:
            yield tuple(np.concatenate(x) for x in zip(*held))

    def pairs(self, visitors: list[str]) -> Iterator[tuple[int, str]]:
        """(visitor's number, resting word) that are near; of one length and top, a visitor is given the lesser words only."""
        wanted, (rows, size) = vectors(visitors), letters(visitors)
        for v, w in self.candidates(wanted):
            short = size[v] < SHORT
            maybe = ~short | near_rows(rows[v], self.rows[w], size[v] == self.size[w])
            v, w, short = v[maybe], w[maybe], short[maybe]
            home = (size[v] == self.size[w]) & (wanted[v, : self.top] == self.vectors[w, : self.top]).all(1)
            for r, at, at_home, known in zip(v.tolist(), w.tolist(), home.tolist(), short.tolist()):
                other = self.words[at]
                if (known or near(visitors[r], other)) and not (at_home and other > visitors[r]):
                    yield r, other


PAIRS = "a string, b string, na long, nb long"
ARROW = pa.schema([("a", pa.string()), ("b", pa.string()), ("na", pa.int64()), ("nb", pa.int64())])


def matched(batches: Iterable[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """dealt rows by block and lane, those at rest first -> near pairs. One lane's resting words are held."""
    at, trie, rest = None, None, {}
    for batch in batches:
        changes = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in batch.columns[:3]] if batch.num_rows else []
        edges = [0, *(np.flatnonzero(np.logical_or.reduce(changes)) + 1).tolist(), batch.num_rows] if changes else []
        out: list[tuple] = []
        for lo, hi in zip(edges, edges[1:]):
            block, lane, visits = (c[lo].as_py() for c in batch.columns[:3])
            if (block, lane) != at:
                at, trie, rest = (block, lane), None, {}
            if visits and not rest:
                continue
            word, n = (c.slice(lo, hi - lo).to_pylist() for c in batch.columns[3:])
            if not visits:
                rest |= zip(word, n)
            else:
                trie = trie or Trie(list(rest), top)
                out.extend((word[i], other, n[i], rest[other]) for i, other in trie.pairs(word))
        yield pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(ARROW)], schema=ARROW)


def near_pairs(vocab: DataFrame) -> DataFrame:
    """vocab (word, n), distinct words -> (a, b, na, nb): every pair of near words once."""
    top = top_levels(vocab.count())
    rows = dealt(vocab, top).repartition("block", "lane").sortWithinPartitions("block", "lane", "visits")
    return rows.mapInArrow(lambda batches: matched(batches, top), PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form), each word once and form never back to it -> (word, root): the last word that the forms lead to.

    Each round every word takes its root's root, so a chain of d forms takes log2(d) rounds; each is cut.
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.drop("moved")


def variants(words: DataFrame, min_letters: int = 5, min_count: int = 3, factor: int = 2) -> DataFrame:
    """words (word, ...), one row an occurrence -> (word, n, n_near, form, form_n, root), one row a word that is long and
    frequent enough.

    n_near: words that differ by one inserted, deleted or replaced code point. form: of these the one of largest n, of ties
    the first in code-point order, if it has factor times the word's n at least; form_n its n. root: where the forms lead
    from the word in the end, the word itself without a form. Null words count as none; repeats are occurrences; a word of
    any length is whole; an empty table gives an empty one; further columns are left out, whatever their names.
    """
    vocab = cut(word_counts(words.select("word"), min_letters, min_count))
    pairs = cut(near_pairs(vocab))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionAll(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("b"))
    kept = F.col("b.m") * -1 >= F.col("n") * factor
    found = cut(vocab.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(kept, F.col("b.other")).alias("form"), F.when(kept, -F.col("b.m")).alias("form_n")))
    led = roots(found.where("form is not null"))
    return found.join(led, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
