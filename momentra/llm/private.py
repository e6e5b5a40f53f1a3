"""Personal data in texts, with DataFrame functions only: patterns propose spans, validators confirm them, context scores them.

A pattern's matches and the texts between them give each match's place, without a shuffle: places are running sums of
lengths, taken in blocks of about the square root of the number of matches, so that many matches in one text cost n^1.5
at most. Patterns are written so that a long run of like characters is scanned once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentra.llm.common import ascii_lower

#: Code points before and after a match, up to the next match of its kind, that its context words are looked for in.
BEFORE, AFTER = 40, 20
#: Least score of a span that isn't of a base kind.
ACCEPT = 60
#: Context words that lower any score, and by how much.
AGAINST, LESS = ("order", "invoice", "isbn", "issn", "version", "ref", "reference", "bestellnummer", "commande", "pedido"), 20


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of value pass Luhn's check."""
    d = F.reverse(digits(value))
    place = F.sequence(F.lit(1), F.length(d))
    worth = lambda i: F.when(i % 2 == 1, F.substr(d, i, F.lit(1)).cast("int")).otherwise(F.substr(F.lit("0246813579"), F.substr(d, i, F.lit(1)).cast("int") + 1, F.lit(1)).cast("int"))
    return F.aggregate(place, F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def mod_97(value: Column) -> Column:
    """Whether an account number, blanks left out, is 1 modulo 97 once its first four characters are moved to the end."""
    v = F.regexp_replace(value, " ", "")
    chars = F.split(F.concat(F.substr(v, F.lit(5)), F.substr(v, F.lit(1), F.lit(4))), "")
    step = lambda r, c: F.when(c.between("0", "9"), r * 10 + c.try_cast("int")).otherwise(r * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), step) == 1


def account(value: Column) -> Column:
    """The longest beginning of value, cut at a blank, that is an account number of 15 to 34 characters; null if none is."""
    parts = F.split(value, " ")
    heads = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), " "))
    size = lambda v: F.length(F.regexp_replace(v, " ", ""))
    return F.get(F.filter(heads, lambda v: size(v).between(15, 34) & mod_97(v)), F.lit(0))


def whole(value: Column) -> Column:
    return value


@dataclass(frozen=True)
class Kind:
    """probe: what a text must hold to be scanned; check: (value, before, after) -> whether the match stands; taken: the part of
    the match that is the span, null for none; score: without context; words: context words, that raise it by gain."""

    name: str
    pattern: str
    probe: str
    check: Callable[[Column, Column, Column], Column]
    score: int
    words: tuple[str, ...]
    gain: int
    taken: Callable[[Column], Column] = whole
    base: bool = False


def _parts_fit(v: Column, before: Column, after: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _apart(before: Column, after: Column, more: str = "") -> Column:
    """No letter, digit or one of `more` stands next to the match."""
    return ~before.rlike(f"[A-Za-z0-9{more}]$") & ~after.rlike(f"^[A-Za-z0-9{more}]")


def _account_apart(v: Column, before: Column, after: Column) -> Column:
    return _apart(before, F.when(account(v) == v, after).otherwise(F.lit("")))


def _social(v: Column, before: Column, after: Column) -> Column:
    return _apart(before, after, "-") & ~v.rlike("^(?:000|666|9)|-00-|-0000$")


def _local(v: Column, before: Column, after: Column) -> Column:
    return _apart(before, after, "-") & ~before.rlike(r"[+.]$|\+[0-9][0-9 ().-]*$") & F.length(digits(v)).between(9, 15)


PHONE_WORDS = ("tel", "phone", "telephone", "call", "fax", "mobile", "cell", "telefon", "handy", "mobil", "téléphone", "tél", "portable", "teléfono", "móvil")

#: Base kinds first, in their order; then those that need a checksum or a context word.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda v, b, a: F.lit(True), 90, ("mail", "email", "e-mail", "contact", "correo", "courriel"), 10, base=True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", _parts_fit, 60, ("ip", "host", "server", "address", "adresse"), 20, base=True),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", "[0-9]", lambda v, b, a: luhn(v), 80, ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"), 20, base=True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", lambda v, b, a: F.length(digits(v)).between(9, 15), 80, PHONE_WORDS, 20, base=True),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "[A-Z]{2}[0-9]{2}", _account_apart, 80, ("iban", "account", "konto", "compte", "cuenta", "bank"), 20, account),
    Kind("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]-[0-9]", _social, 40, ("ssn", "social security", "social"), 40),
    Kind("local_phone", r"\(?[0-9]{2,5}\)?(?:[ -][0-9]{2,5}){1,4}", "[0-9][ )-]", _local, 30, PHONE_WORDS, 40),
)


def has_word(text: Column, words: tuple[str, ...]) -> Column:
    return ascii_lower(text).rlike(f"[^a-zà-ÿ](?:{'|'.join(words)})[^a-zà-ÿ]")


def running_sums(blocks: Column) -> Column:
    """blocks of (gap, size) -> the sum of all that stands before each entry, its own gap included."""
    none = lambda kind: F.struct(F.expr(f"cast(array() as array<{kind}>)").alias("s"), F.lit(0).alias("at"))
    put = lambda acc, one, more: F.struct(F.concat(acc["s"], F.array(one)).alias("s"), (acc["at"] + more).alias("at"))
    inner = F.transform(blocks, lambda b: F.aggregate(b, none("int"), lambda acc, x: put(acc, acc["at"] + x["gap"], x["gap"] + x["size"])))
    outer = F.aggregate(inner, none("array<int>"), lambda acc, w: put(acc, F.transform(w["s"], lambda y: y + acc["at"]), w["at"]))
    return F.flatten(outer["s"])


def _span(kind: Kind, x: Column, start: Column) -> Column:
    value = kind.taken(x["value"])
    near = F.concat(F.when(F.length(x["before"]) <= BEFORE, F.lit(" ")).otherwise(F.lit("")), F.right(x["before"], F.lit(BEFORE)), F.lit(" "), F.left(x["after"], F.lit(AFTER)), F.when(F.length(x["after"]) <= AFTER, F.lit(" ")).otherwise(F.lit("")))
    score = kind.score + F.when(has_word(near, kind.words), kind.gain).otherwise(0) - F.when(has_word(near, AGAINST), LESS).otherwise(0)
    ok = value.isNotNull() & kind.check(x["value"], x["before"], x["after"])
    if not kind.base:
        ok = ok & (score >= ACCEPT)
    return F.when(ok, F.struct(F.lit(kind.name).alias("kind"), start.cast("long").alias("start"), (start + F.length(value)).cast("long").alias("end"), score.alias("score")))


def find_private(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, spans array<struct<kind, start, end, score>>), one row a row of docs.

    Spans by kind in the order of KINDS, then by start; start and end in code points, end exclusive; score from 0 to 100. A
    base kind's matches stand if they pass its validator, whatever their score; other kinds' only with a score of ACCEPT.
    Matches of one kind don't overlap; of two kinds they may. Nothing is shuffled. A null or empty text has no spans; null
    ids and repeated rows are rows like others; very long texts are scanned whole; an empty table gives an empty one;
    further columns are left out, whatever their names.
    """
    no_text, t = F.expr("cast(array() as array<string>)"), F.col("t")
    x = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    holds = lambda k: t.contains(k.probe) if len(k.probe) == 1 else t.rlike(k.probe)
    x = x.select("*", *[F.when(holds(k), F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))).otherwise(no_text).alias(f"m_{k.name}") for k in KINDS])
    x = x.select("*", *[F.when(F.size(f"m_{k.name}") > 0, F.split(t, k.pattern, -1)).otherwise(no_text).alias(f"g_{k.name}") for k in KINDS])
    for k in KINDS:
        m, g = F.col(f"m_{k.name}"), F.col(f"g_{k.name}")
        gaps = F.zip_with(F.slice(g, F.lit(1), F.size(m)), F.slice(g, F.lit(2), F.size(m)), lambda b, a: F.struct(F.length(b).alias("gap"), F.right(b, F.lit(BEFORE + 1)).alias("before"), F.left(a, F.lit(AFTER + 1)).alias("after")))
        joined = F.zip_with(m, gaps, lambda v, y: F.struct(y["gap"].alias("gap"), F.length(v).alias("size"), v.alias("value"), y["before"].alias("before"), y["after"].alias("after")))
        x = x.withColumn(f"z_{k.name}", joined)
    step = lambda z: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(z)))).cast("int")
    blocks = lambda z: F.transform(F.sequence(F.lit(0), F.floor(F.size(z) / step(z)).cast("int")), lambda i: F.slice(z, i * step(z) + 1, step(z)))
    x = x.select("doc_id", *[F.col(f"z_{k.name}") for k in KINDS], *[running_sums(blocks(F.col(f"z_{k.name}"))).alias(f"s_{k.name}") for k in KINDS])
    kept = lambda k: F.filter(F.zip_with(f"z_{k.name}", f"s_{k.name}", lambda y, s: _span(k, y, s)), lambda y: y.isNotNull())
    return x.select("doc_id", F.concat(*map(kept, KINDS)).alias("spans"))
