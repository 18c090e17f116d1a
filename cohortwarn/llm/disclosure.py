"""Personal data and the terms that give it away.

Four kinds of personal data are found by pattern and check (email, ip, card, phone).  Each distinct value is a
protected entity.  The corpus then says how strongly a term in its documents reveals it: with document counts n, the
pointwise mutual information of term and entity is log(n_te N / (n_t n_e)), and the whole information of the entity
is log(N / n_e).  A term that gives away at least the share ``GENERALISE`` of that information is replaced by a
general word, from ``REMOVE`` on it is removed.  Few texts prove little: from k different texts with both, only
(k - ``DOUBT``) / k of the common documents count, so of an entity in one text only terms that hardly any other document
has are touched.  All their occurrences in the entity's documents are.

All counts are over all documents and whole texts.  A term can only reach the share while n_t is at most
n_e ^ GENERALISE N ^ (1 - GENERALISE), so more frequent terms are left out before they are paired with entities.
Entities of one text only have the same counts, so they are one entity here: no text pairs all its entities with all its
terms.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwarn.llm.common import add_columns, slices, text_of
from cohortwarn.session import stable

# Kinds in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
#: Shares of information, texts that do not count, and counters a task holds.
GENERALISE, REMOVE, DOUBT, HELD = 0.75, 0.95, 0.75, 500_000
STRIP = ".,;:!?\"'()[]{}<>«»“”„…|"

# Patterns of the contract, and their parts.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*").finditer
_DIGITS = re.compile(r"[0-9]+").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_NOT_DIGIT = re.compile(r"[^0-9]")
_TOKENS = re.compile(r"\S+").finditer


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, in time linear in the text: around each @, the longest local part that begins
    after the match before, and the longest domain."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((start, done))
        else:
            done = max(done, at + 1)  # no local part reaches over an @
        at = text.find("@", max(done, at + 1))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Matches of four numbers joined by dots, from left to right without overlap, parts at most 255."""
    out = []
    for run in _DOTTED(text):
        if run.group().count(".") < 3:
            continue
        parts: list[tuple[int, int]] = []
        for m in _DIGITS(text, run.start(), run.end()):
            if parts and m.start() != parts[-1][1] + 1:
                parts = []
            parts.append(m.span())
            if len(parts) == 4:
                if all(b - a <= 3 or not text[a : b - 3].strip("0") for a, b in parts) \
                        and all(int(text[max(a, b - 3) : b]) <= 255 for a, b in parts):
                    out.append((parts[0][0], parts[3][1]))
                parts = []
    return out


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of ``KINDS``."""
    found = [(a, k, b) for k, f in enumerate((emails, addresses, cards, phones)) for a, b in f(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def entity(kind: str, value: str) -> str:
    """One name for all spellings of a value."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _NOT_DIGIT.sub('', value)}"


def term(token: str) -> str:
    return token.strip(STRIP).lower()


def terms(text: str, spans: list[tuple[int, int, str]]) -> list[dict]:
    """Terms outside the spans of a text that has any: term, start, end (code points)."""
    out, first = [], 0
    ordered = sorted(spans)
    for m in _TOKENS(text) if spans else ():
        x, y = m.span()
        # Spans of two kinds may overlap, so those that ended are only passed while they come first.
        while first < len(ordered) and ordered[first][1] <= x:
            first += 1
        at, inside = first, False
        while at < len(ordered) and ordered[at][0] < y and not inside:
            inside = x < ordered[at][1]
            at += 1
        token = m.group()
        word = term(token)
        if not inside and len(word) >= 3 and any(map(str.isalpha, word)):
            start = x + len(token) - len(token.lstrip(STRIP))
            out.append({"term": word, "start": start, "end": start + len(token.strip(STRIP))})
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join([f"{kind}:{a}:{b}" for a, b, kind in spans])


def _md5(text) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def row_key() -> Column:
    """128 bits that stand for doc_id and text; equal rows have equal keys."""
    return _md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, key, content, counts, base, base_sha256, entities and terms of each row."""
    rows = docs.select("doc_id", "text", row_key().alias("key"), _md5(text_of()).alias("content"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)

    def make():
        def compute(batch: pa.RecordBatch) -> list:
            numbers, bases, hashes, names, found = [[] for _ in KINDS], [], [], [], []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                for kind, out in zip(KINDS, numbers, strict=True):
                    out.append(sum([s[2] == kind for s in spans]))
                bases.append(joined(spans))
                hashes.append(hashlib.sha256(bases[-1].encode()).hexdigest())
                names.append(sorted({entity(k, text[a:b]) for a, b, k in spans}))
                found.append(terms(text, spans))
            return [*numbers, bases, hashes, names, found]

        return compute

    fields = (f"{counts}, base string, base_sha256 string, entities array<string>, "
              "terms array<struct<term:string,start:int,end:int>>")
    return add_columns(rows, [text_of()], fields, make).drop("text")


def document_counts(docs: DataFrame) -> DataFrame:
    """h, n_t: in how many documents the terms of a 64-bit hash occur.  Terms are counted within tasks before they are
    sent."""

    def flush(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"term": pa.array(list(held), pa.string()),
                                           "n": pa.array(list(held.values()), pa.int64())})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                held.update({t.strip(STRIP) for t in set(text.lower().split())})
            if len(held) > HELD:
                yield flush(held)
                held = Counter()
        yield flush(held)

    counted = docs.filter("text is not null").select("text").mapInArrow(work, "term string, n long")
    return counted.filter("length(term) >= 3").select(F.xxhash64("term").alias("h"), "n").groupBy("h").agg(
        F.sum("n").alias("n_t"))


def disclosing(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """content, h, share: terms of a text that give away at least ``GENERALISE`` of an entity in it."""
    n = scanned.count()
    # Each different text with entities once, with its copies and the hashes of its terms.
    words = F.array_distinct(F.transform("terms", lambda x: F.xxhash64(x["term"])))
    texts = stable(scanned.filter("size(entities) > 0").select("content", "entities", words.alias("words")).groupBy(
        "content").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("words").alias("words")),
        "texts")
    named = texts.select("content", "copies", F.explode("entities").alias("entity"))
    per_entity = named.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts"))
    several = stable(named.join(per_entity.filter(f"texts > 1 and n_e < {n}"), "entity").select(
        "content", "copies", "entity", "n_e"), "entities")
    alone = texts.select("content", "copies", F.lit(None).cast("string").alias("entity"), F.col("copies").alias("n_e"))
    # The entities that stand in one text only: at least one, else nothing of the kind is known of the text.
    single = named.join(per_entity.filter("texts = 1"), "entity").select("content").distinct()
    alone = alone.filter(F.col("copies") < n).join(single, "content", "left_semi")
    owners = several.unionByName(alone)
    most = owners.agg(F.max("n_e")).first()[0]
    if most is None:
        return texts.select("content", F.lit(0).cast("long").alias("h"), F.lit(0.0).alias("share")).limit(0)
    # The slack covers rounding.
    reach = lambda n_e: F.pow(n_e, F.lit(GENERALISE)) * float(n) ** (1 - GENERALISE) * (1 + 1e-9)
    placed = texts.select("content", F.explode("words").alias("h"))
    n_t = document_counts(docs).filter(F.col("n_t") <= reach(F.lit(float(most))))
    rare = stable(placed.join(n_t, "h"), "rare-terms")
    pairs = owners.join(rare, "content").filter(F.col("n_t") <= reach(F.col("n_e")))
    known = F.col("n_te") * (F.col("k") - DOUBT) / F.col("k")
    share = F.log(known * float(n) / (F.col("n_t") * F.col("n_e"))) / F.log(float(n) / F.col("n_e"))
    # Of an entity in one text the text stands for it.
    found = pairs.withColumn("own", F.when(F.col("entity").isNull(), F.col("content"))).groupBy(
        "entity", "own", "h", "n_e", "n_t").agg(F.sum("copies").alias("n_te"), F.count("*").alias("k"))
    found = stable(found.withColumn("share", share).filter(F.col("share") >= GENERALISE).select("entity", "own", "h", "share"),
                   "disclosing")
    of_several = several.join(found.filter("own is null").select("entity", "h", "share"), "entity").join(
        rare.select("content", "h"), ["content", "h"], "left_semi").select("content", "h", "share")
    of_single = found.filter("own is not null").select(F.col("own").alias("content"), "h", "share")
    return of_several.unionByName(of_single).groupBy("content", "h").agg(F.max("share").alias("share"))


def find(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, key, n_email, n_ip, n_card, n_phone, base, base_sha256, added, spans.

    ``added`` lists the disclosing terms (start, end, share); ``spans`` joins all spans as ``kind:start:end``, the
    kind of an added one being ``term``.  A null text counts as empty: no spans.  Repeated rows give equal rows; an
    empty table gives none.  Only doc_id and text are read.
    """
    scanned = stable(scan(docs), "personal-data")
    found = disclosing(docs, scanned)
    placed = scanned.filter("size(entities) > 0").select("key", "content", F.explode("terms").alias("x")).select(
        "key", "content", "x.start", "x.end", F.xxhash64("x.term").alias("h")).distinct()
    added = placed.join(found, ["content", "h"]).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "share"))).alias("added"))
    out = scanned.drop("entities", "terms", "content").join(stable(added, "added"), "key", "left")

    ordered = F.split(F.col("base"), ",")
    base = F.transform(F.filter(ordered, lambda s: s != ""), lambda s: F.struct(
        F.split(s, ":")[1].cast("int").alias("start"), F.array_position(
            F.array(*[F.lit(k) for k in KINDS]), F.split(s, ":")[0]).cast("int").alias("kind"), s.alias("span")))
    more = F.transform(F.coalesce("added", F.array().cast("array<struct<start:int,end:int,share:double>>")),
                       lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS) + 1).alias("kind"), F.concat(
                           F.lit("term:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")).alias("span")))
    spans = F.array_join(F.transform(F.sort_array(F.concat(base, more)), lambda x: x["span"]), ",")
    return out.withColumn("spans", spans)


def sanitise(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` plus ``spans`` and ``clean_text``: base spans become their kind in brackets,
    disclosing terms become ``[WORD]`` or, from ``REMOVE`` on, go."""
    found = find(docs).select("key", "spans", "added").dropDuplicates(["key"]).toDF("_key", "_spans", "_added")
    both = docs.join(found, row_key() == F.col("_key")).drop("_key")

    def make():
        def clean(text: str | None, spans: str, added: list | None) -> str:
            shares = {(x["start"], x["end"]): x["share"] for x in added or []}
            out, at = [], 0
            for span in filter(None, spans.split(",")):
                kind, a, b = span.split(":")
                a, b = int(a), int(b)
                if b <= at:
                    continue
                out.append((text or "")[at:max(a, at)])
                if kind != "term":
                    out.append(f"[{kind.upper()}]")
                elif shares[a, b] < REMOVE:
                    out.append("[WORD]")
                at = b
            return "".join(out) + (text or "")[at:]

        def compute(batch: pa.RecordBatch) -> list:
            text, spans, added = [c.to_pylist() for c in batch.columns]
            return [spans, [clean(*x) for x in zip(text, spans, added, strict=True)]]

        return compute

    inputs = [F.col("text"), F.col("_spans"), F.col("_added")]
    return add_columns(both, inputs, "spans string, clean_text string", make).drop("_spans", "_added")
