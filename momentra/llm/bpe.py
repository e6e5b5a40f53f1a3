"""Byte-level BPE by recursive DuckDB queries, one database a Spark partition.

Pretokens are numbered once. New ones are contracted by a recursive query: rows are (word, position, token), each step
joins neighbouring tokens with the merge table and contracts every word's leftmost pair of least rank, until no word has
a pair. Documents are then joined from their words' tokens by ordered aggregation, and the ids so found are decoded by
ordered aggregation of their bytes, which must give the text again.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentra.llm.common import release_memory

#: Text characters that go through the database at once; longer texts go in segments of so many.
CHUNK_CHARS = 512 << 10
#: Pieces that the word tables hold before they are begun anew.
PIECES = 400_000
#: Words of up to STEP_BYTES go through CONTRACT, whose rows are as many as the sum of the words' squares: SQUARES at once.
#: Longer ones go through CONTRACT_RUNS, which keeps one row a byte: RUN_BYTES at once, or one word if that is longer.
STEP_BYTES, SQUARES, RUN_BYTES = 64, 1 << 20, 256 << 10
#: What the database may hold in memory.
MEMORY = "400MB"

#: start: a token (id) of word w at pos, the places before and after it (-1: none) and the next token.
#: best: a word's leftmost pair of least rank, the second place of the pair and what follows it. One pair a word and step.
CONTRACT = """
WITH RECURSIVE step(w, pos, after, before, id, next_id, depth) AS (
    SELECT w, pos, after, before, id, next_id, 0 FROM start
    UNION ALL
    SELECT s.w, s.pos,
           CASE WHEN s.pos = best.pos THEN best.then_after ELSE s.after END,
           CASE WHEN s.before = best.second THEN best.pos ELSE s.before END,
           CASE WHEN s.pos = best.pos THEN best.rank ELSE s.id END,
           CASE WHEN s.pos = best.pos THEN best.then_id WHEN s.after = best.pos THEN best.rank ELSE s.next_id END,
           s.depth + 1
    FROM step s JOIN (
        SELECT x.w, x.pos, x.rank, y.pos AS second, y.after AS then_after, y.next_id AS then_id
        FROM (
            SELECT w, min(rank::BIGINT * 65536 + pos) AS least, (least % 65536)::INTEGER AS pos, (least // 65536)::INTEGER AS rank
            FROM step JOIN merges ON pair = id::BIGINT * 65536 + next_id GROUP BY w
        ) x JOIN step y ON y.w = x.w AND y.before = x.pos
    ) best ON s.w = best.w
    WHERE s.pos != best.second
)
SELECT step.w, pos, id FROM step JOIN (SELECT w, max(depth) AS depth FROM step GROUP BY w) USING (w, depth)
"""

#: The same for long words, with all the pairs of least rank from the left in one step. The table is keyed, so a place
#: has one row whatever the number of steps, and only changed rows go on. hit: the pairs of least rank; chosen: every
#: other one where they overlap; take: up to the first that makes a pair of still lesser rank, which has to come before
#: the rest. That is the order of one leftmost least pair after the other.
CONTRACT_RUNS = """
WITH RECURSIVE token(w, pos, id, before, after, next_id, rank) USING KEY (w, pos) AS (
    SELECT w, pos, id, before, after, next_id, rank FROM start LEFT JOIN merges ON pair = id::BIGINT * 65536 + next_id
    UNION
    SELECT w, pos, id, before, after, next_id, CASE WHEN id >= 0 THEN merges.rank END
    FROM (
        WITH live AS MATERIALIZED (SELECT * FROM recurring.token WHERE id >= 0 AND w IN (SELECT w FROM token)),
        hit AS (
            SELECT w, pos, before, after AS second, least, coalesce(lag(after) OVER place = pos, false) AS linked, row_number() OVER place AS i
            FROM live JOIN (SELECT w, min(rank) AS least FROM live GROUP BY w) USING (w) WHERE rank = least
            WINDOW place AS (PARTITION BY w ORDER BY pos)
        ),
        chosen AS (
            SELECT * FROM (SELECT *, i - max(CASE WHEN linked THEN 0 ELSE i END) OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING) AS turn FROM hit) WHERE turn % 2 = 0
        ),
        pair AS (
            SELECT c.w, c.pos, c.before, c.second, c.least, s.after AS next, s.next_id AS right_id, b.id AS left_id,
                   lag(c.pos) OVER place AS last, coalesce(lag(c.second) OVER place = c.before, false) AS joined
            FROM chosen c JOIN live s ON s.w = c.w AND s.pos = c.second LEFT JOIN live b ON b.w = c.w AND b.pos = c.before
            WINDOW place AS (PARTITION BY c.w ORDER BY c.pos)
        ),
        take AS (
            SELECT *, lead(pos) OVER place AS following FROM (
                SELECT p.*, coalesce(bool_or(l.rank < least OR r.rank < least) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late
                FROM pair p
                LEFT JOIN merges l ON l.pair = (CASE WHEN joined THEN least ELSE left_id END)::BIGINT * 65536 + least
                LEFT JOIN merges r ON r.pair = least::BIGINT * 65536 + right_id
            ) WHERE NOT late WINDOW place AS (PARTITION BY w ORDER BY pos)
        ),
        mark AS (
            SELECT w, pos, max(id) AS id, max(before) AS before, max(after) AS after, max(next_id) AS next_id FROM (
                SELECT w, pos, least AS id, CASE WHEN joined THEN last END AS before, next AS after, CASE WHEN following = next THEN least ELSE right_id END AS next_id FROM take
                UNION ALL SELECT w, second, -1, NULL, NULL, NULL FROM take
                UNION ALL SELECT w, next, NULL, pos, NULL, NULL FROM take WHERE next >= 0 AND following IS DISTINCT FROM next
                UNION ALL SELECT w, before, NULL, NULL, NULL, least FROM take WHERE before >= 0 AND NOT joined
            ) GROUP BY w, pos
        )
        SELECT w, pos, coalesce(mark.id, live.id) AS id, coalesce(mark.before, live.before) AS before, coalesce(mark.after, live.after) AS after, coalesce(mark.next_id, live.next_id) AS next_id
        FROM live JOIN mark USING (w, pos)
    ) LEFT JOIN merges ON pair = id::BIGINT * 65536 + next_id
)
SELECT w, pos, id FROM token WHERE id >= 0
"""


#: Where a text may be cut: before a space after a non-blank. BLANK_SPACE: there is a space where it may not.
CUT, BLANK_SPACE = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=2)
def merge_table(path: str) -> pa.Table:
    """(pair, rank): every pair of tokens whose joined bytes are a token, as a * 65536 + b; its rank is that token's.

    Kept for a worker's further partitions."""
    ranks = load_ranks(path)
    rows = [(ranks[t[:i]] * 65536 + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    pair, rank = zip(*rows) if rows else ((), ())
    return pa.table({"pair": pa.array(pair, pa.int64()), "rank": pa.array(rank, pa.int32())})


class Codec:
    """A database of vocab, merges, words (k, n, ids) and pieces (k, n, ids) of the text so far; ids are decimal, comma-joined.

    A text is cut before each single space that follows a non-blank; pretokens never cross such a cut, so repeated
    pieces are split and looked up once.
    """

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks, self.split = load_ranks(path), regex.compile(pattern).findall
        if max(self.ranks.values(), default=0) >= 65_536:
            raise ValueError("pairs are packed for ranks below 65536")
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = vocabulary(self.ranks)
        self.fill("CREATE TABLE merges AS SELECT * FROM given", given=merge_table(path))
        self.forget()

    def fill(self, query: str, **tables: pa.Table) -> None:
        for name, table in tables.items():
            self.db.register(name, table)
        self.db.execute(query)
        for name in tables:
            self.db.unregister(name)

    def forget(self) -> None:
        self.word: dict[str, int] = {}
        self.piece: dict[str | tuple[str], int] = {}
        for name in ("words", "pieces"):
            self.db.execute(f"CREATE OR REPLACE TABLE {name} (k INTEGER, n BIGINT, ids VARCHAR)")

    def cut(self, text: str) -> list[str | tuple[str]]:
        """The text's pieces: a string stands for itself after a space, a tuple for its content alone."""
        if not text:
            return []
        if BLANK_SPACE.search(text):
            return [(x,) for x in CUT.split(text)]
        first, *rest = text.split(" ")
        return [(first,), *rest]

    def start(self, words: list[bytes], number: list[int]) -> pa.Table:
        size = np.fromiter(map(len, words), np.int64, len(words))
        w = np.repeat(np.array(number, np.int32), size)
        pos = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        last = pos == np.repeat(size, size) - 1
        return pa.table(
            {
                "w": w, "pos": pos, "after": np.where(last, -1, pos + 1).astype(np.int32), "before": pos - 1, "id": ids,
                "next_id": np.where(last, -1, np.roll(ids, -1)).astype(np.int32),
            }
        )

    def learn_words(self, new: list[str], first: int) -> None:
        """Contract the words numbered from `first` on."""
        todo: dict[str, list[tuple[bytes, int]]] = {CONTRACT: [], CONTRACT_RUNS: []}
        whole: list[tuple[int, int]] = []
        for i, x in enumerate(new, first):
            word = x.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(word)) is not None:
                whole.append((i, rank))
            else:
                todo[CONTRACT if len(word) <= STEP_BYTES else CONTRACT_RUNS].append((word, i))
        if whole:
            k, rank = zip(*whole)
            self.fill("INSERT INTO words SELECT k, 1, id::VARCHAR FROM given", given=pa.table({"k": pa.array(k, pa.int32()), "id": pa.array(rank, pa.int32())}))
        join = "INSERT INTO words SELECT w, count(*), string_agg(id::VARCHAR, ',') FROM (SELECT w, id FROM ({}) ORDER BY w, pos) GROUP BY w"
        for query, cost, most in ((CONTRACT, lambda n: n * n, SQUARES), (CONTRACT_RUNS, lambda n: n, RUN_BYTES)):
            for part in chunks(todo[query], [cost(len(x)) for x, _ in todo[query]], most):
                self.fill(join.format(query), start=self.start([x for x, _ in part], [i for _, i in part]))

    def learn(self, new: list[str | tuple[str]], first: int) -> None:
        """Split the pieces numbered from `first` on, contract their new words and join the pieces from them."""
        split = [self.split(x[0] if isinstance(x, tuple) else f" {x}") for x in new]
        known, word = len(self.word), self.word
        w = [word.setdefault(x, len(word)) for ws in split for x in ws]
        if len(word) > known:
            self.learn_words(list(word)[known:], known)
        size = np.array([len(ws) for ws in split])
        p = np.repeat(np.arange(first, first + len(new), dtype=np.int32), size)
        one = np.repeat(size == 1, size)
        k, place = np.array(w, np.int32), np.arange(len(w), dtype=np.int32)
        self.fill("INSERT INTO pieces SELECT p, n, ids FROM given JOIN words USING (k)", given=pa.table({"p": p[one], "k": k[one]}))
        given = pa.table({"p": p[~one], "place": place[~one], "k": k[~one]})
        self.fill("INSERT INTO pieces SELECT p, sum(n), string_agg(ids, ',') FROM (SELECT * FROM given JOIN words USING (k) ORDER BY place) GROUP BY p", given=given)

    def encode(self, texts: list[str]) -> pa.Table:
        """(doc, n, ids) of the texts, in their order."""
        cuts = [self.cut(t) for t in texts]
        if len(self.piece) > PIECES:
            self.forget()
        piece, first = self.piece, len(self.piece)
        parts = [np.fromiter((piece.setdefault(x, len(piece)) for x in ps), np.int32, len(ps)) for ps in cuts]
        seq = np.concatenate([np.zeros(0, np.int32), *parts])
        if len(piece) > first:
            self.learn(list(piece)[first:], first)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(ps) for ps in cuts])
        self.db.register("token", pa.table({"doc": doc, "place": np.arange(len(seq), dtype=np.int32), "k": seq}))
        self.db.register("text", pa.table({"doc": np.arange(len(texts), dtype=np.int32)}))
        found = self.db.sql("""
            SELECT doc, coalesce(n, 0)::BIGINT AS n, coalesce(ids, '') AS ids FROM (
                SELECT doc, sum(n) AS n, string_agg(ids, ',') AS ids FROM (SELECT * FROM token JOIN pieces USING (k) ORDER BY place) GROUP BY doc
            ) RIGHT JOIN text USING (doc) ORDER BY doc""").to_arrow_table()
        self.db.unregister("token")
        self.db.unregister("text")
        return found

    def run(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        """(number of tokens, ids, the bytes that the ids decode to) of each text; an error if these aren't the text's."""
        found = self.encode(texts)
        decoded = decode_ids(self.db, found)
        if decoded != [t.encode("utf-8", "surrogatepass") for t in texts]:
            raise ValueError("decoded bytes differ from the text")
        return list(zip(found["n"].to_pylist(), found["ids"].to_pylist(), decoded))

    def documents(self, texts: Iterable[str]) -> Iterator[list[tuple[int, str, bytes]]]:
        """For each text what run gives for its segments."""
        flat = [(i, x) for i, t in enumerate(texts) for x in segments(t)]
        out: list[tuple[int, str, bytes]] = []
        last = 0
        for part in chunks(flat, [len(x) for _, x in flat], CHUNK_CHARS):
            for (i, _), row in zip(part, self.run([x for _, x in part])):
                if i != last:
                    yield out
                    out, last = [], i
                out.append(row)
        if flat:
            yield out


def chunks(rows: list, cost: list[int], most: int) -> Iterator[list]:
    """rows in runs whose cost is `most` together, or one row."""
    at = 0
    while at < len(rows):
        end, total = at, 0
        while end < len(rows) and (end == at or total + cost[end] <= most):
            total += cost[end]
            end += 1
        yield rows[at:end]
        at = end


def segments(text: str) -> list[str]:
    """A text in parts of CHUNK_CHARS or a little more, cut where no pretoken crosses; at least one."""
    out, at = [], 0
    while len(text) - at > CHUNK_CHARS and (m := CUT.search(text, at + CHUNK_CHARS)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def vocabulary(ranks: dict[bytes, int]) -> duckdb.DuckDBPyConnection:
    """A database with the table vocab (id, hex)."""
    db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    db.register("given", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]}))
    db.execute("CREATE TABLE vocab AS SELECT * FROM given")
    db.unregister("given")
    return db


def decode_ids(db: duckdb.DuckDBPyConnection, encoded: pa.Table) -> list[bytes]:
    """encoded (doc, n, ids) -> the bytes of each row's ids, in their order; an unknown id is an error."""
    db.register("encoded", encoded)
    found = db.sql("""
        SELECT coalesce(h.n, 0) = encoded.n AS known, coalesce(unhex(hex), ''::BLOB) AS decoded FROM (
            SELECT doc, count(*) AS n, string_agg(hex, '') AS hex FROM (
                SELECT doc, hex FROM (
                    SELECT doc, unnest(ids) AS id, generate_subscripts(ids, 1) AS place FROM (SELECT doc, string_split(ids, ',')::INTEGER[] AS ids FROM encoded WHERE ids <> '')
                ) JOIN vocab USING (id) ORDER BY doc, place
            ) GROUP BY doc
        ) h RIGHT JOIN encoded USING (doc) ORDER BY doc""").to_arrow_table()
    db.unregister("encoded")
    if not all(found["known"].to_pylist()):
        raise ValueError("an id is not in the vocabulary")
    return found["decoded"].to_pylist()


def _digests(parts: list[tuple[int, str, bytes]]) -> tuple[int, str, str]:
    n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
    for i, (k, x, raw) in enumerate(parts):
        n += k
        ids.update(f"{',' * (i > 0)}{x}".encode())
        decoded.update(raw)
    return n, ids.hexdigest(), decoded.hexdigest()


def _whole(parts: list[tuple[int, str, bytes]]) -> tuple[int, list[int], bytes]:
    ids = [int(i) for _, x, _ in parts if x for i in x.split(",")]
    return len(ids), ids, b"".join(raw for *_, raw in parts)


def _through(docs: DataFrame, row: Callable[[list], tuple], path: str, pattern: str, schema: str) -> DataFrame:
    """Python sees the texts alone, so ids of any size stay as they are. A partition has one codec, which ends with it."""
    columns = [c.split()[0] for c in schema.split(", ")]

    @F.pandas_udf(schema)
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(path, pattern)
        release_memory()
        for texts in batches:
            yield pd.DataFrame([row(parts) for parts in codec.documents(t or "" for t in texts)], columns=columns)
        codec.db.close()
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), coded(F.col("text").cast("string")).alias("x")).select("doc_id", "x.*")


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256), one row a row of docs; null text is empty.

    ids_sha256: of the decimal ids joined by commas; decoded_sha256: of the bytes that these ids decode to.
    """
    return _through(docs, _digests, path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_tokens, ids array<int>, decoded binary)."""
    return _through(docs, _whole, path, pattern, "n_tokens long, ids array<int>, decoded binary")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """tokens (doc_id, ids array<int>) -> (doc_id, decoded binary); null ids decode to nothing, an unknown id is an error."""

    @F.pandas_udf("binary")
    def decoded(ids: pd.Series) -> pd.Series:
        lists = [[] if x is None else list(x) for x in ids]
        table = pa.table({"doc": np.arange(len(lists), dtype=np.int32), "n": [len(x) for x in lists], "ids": [",".join(map(str, x)) for x in lists]})
        return pd.Series(decode_ids(vocabulary(load_ranks(path)), table))

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), decoded(F.col("ids").cast("array<int>")).alias("decoded"))
