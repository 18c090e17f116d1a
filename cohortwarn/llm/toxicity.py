"""Toxicity by Levenshtein automata over a lexicon trie, with scores for the context of each hit.

Learning (from labelled rows outside the held-out third, a bounded sample of them):

1. Half of the sample gives the lexicon: words, and beginnings of words, that are much more frequent in toxic texts
   (likelihood ratio and log odds of document counts).
2. The other half gives the weights of a logistic regression over what the lexicon finds in a text.

Scoring one text is a pass over its words.  A word that is not in the lexicon and begins with none of its stems is
read by its Levenshtein automaton, as bit sets of positions for each number of errors, along the branches of the
trie; dead branches are left at once.  The window around each hit decides between abuse (second person) and
quotation (inside quotes, or a verb of saying); quoted hits count as a feature of their own.

Score and prediction use the text only; ids, labels, languages and sources play no part in them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwarn.llm.common import add_columns, held_out, slices
from cohortwarn.session import stable

#: Labelled rows that learning uses at most, those with the smallest hash of the id.
SAMPLE = 20_000
#: Lexicon entries at most, the least toxic texts an entry occurs in (as a share and a number), least log odds, and
#: least likelihood ratio.
ENTRIES, LEAST_SHARE, LEAST_TEXTS, LEAST_ODDS, LEAST_RATIO = 2_000, 0.01, 3, 2.0, 10.0
STEMS = (4, 5, 6)  # lengths of word beginnings
EDITS, SHORTEST = 1, 5  # errors allowed, in words of at least so many letters
WINDOW = 5  # words on either side of a hit
THRESHOLD = 0.7
KEPT_WORDS = 200_000

# Words and signs that tell abuse from quotation, in the languages of the tables.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti "
                          "tu usted ustedes eres".split())
SAYING = frozenset("said says say wrote writes called calls quoted quote quotes term word sagte sagt schrieb nannte "
                   "dit disait écrit mot dijo dice escribió palabra".split())
QUOTES = '"“”„«»‹›'

_WORDS = re.compile(r"[^\W_]+(?:[@$*!|'’]+[^\W_]+)*").findall
FEATURES = ("exact", "near", "stems", "quoted", "heaviest", "weight")


class Lexicon:
    """Terms with weights; a term ending in ``*`` stands for all longer words that begin so."""

    def __init__(self, weights: dict[str, float]):
        self.words = {t: w for t, w in weights.items() if not t.endswith("*")}
        self.stems = {t[:-1]: w for t, w in weights.items() if t.endswith("*")}
        self.nodes: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        # For each beginning and end of a term, the lengths of such terms as a bit set.
        self.heads: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        for term in self.words:
            at = 0
            for c in term:
                if c not in self.nodes[at]:
                    self.nodes[at][c] = len(self.nodes)
                    self.nodes.append({})
                at = self.nodes[at][c]
            self.ends[at] = term
            for i in range(1, len(term) + 1):
                self.heads[term[:i]] = self.heads.get(term[:i], 0) | 1 << len(term)
                self.tails[term[-i:]] = self.tails.get(term[-i:], 0) | 1 << len(term)
        self.kept: dict[str, tuple | None] = {}

    def within(self, word: str, edits: int = EDITS) -> tuple[str, int] | None:
        """The nearest term (then the first by name) at most ``edits`` insertions, deletions or replacements away.

        Bit i of the set for e errors: the first i letters of the word are read, with e errors.
        """
        reads: dict[str, int] = {}
        for i, c in enumerate(word):
            reads[c] = reads.get(c, 0) | 1 << i
        start, done = [(1 << (e + 1)) - 1 for e in range(edits + 1)], 1 << len(word)
        found, stack = None, [(0, start)]
        while stack:
            node, sets = stack.pop()
            if node in self.ends:
                for e, s in enumerate(sets):
                    if s & done:
                        best = (e, self.ends[node])
                        found = best if found is None or best < found else found
                        break
            branches = self.nodes[node]
            if not any(sets[:-1]):
                # No error is left to make: only the letters that come next in the word lead on.
                last = sets[-1] & (done - 1)
                while last:
                    low = last & -last
                    last ^= low
                    c = word[low.bit_length() - 1]
                    if c in branches:
                        stack.append((branches[c], [*sets[:-1], (sets[-1] & reads[c]) << 1]))
                continue
            for c, child in branches.items():
                mask, after, below = reads.get(c, 0), [], 0
                for e, s in enumerate(sets):
                    new = (s & mask) << 1
                    if e:
                        # the term's letter is extra, or replaces the word's, or the word's letter is extra
                        new |= sets[e - 1] | sets[e - 1] << 1 | below << 1
                    after.append(new)
                    below = new
                if any(after):
                    stack.append((child, after))
        return (found[1], found[0]) if found else None

    def find(self, word: str) -> tuple[str, float, str] | None:
        """(kind, weight, term) of a word in lower case."""
        if word in self.words:
            return "exact", self.words[word], word
        for n in reversed(STEMS):
            if len(word) > n and word[:n] in self.stems:
                return "stems", self.stems[word[:n]], word[:n]
        n = len(word)
        if n < SHORTEST:
            return None
        # One error leaves one half of the word as it is, at the same end of a term whose length differs by one at most.
        half, lengths = n // 2, 0b111 << (n - 1)
        if (self.heads.get(word[:half], 0) | self.tails.get(word[half:], 0)) & lengths and (near := self.within(word)):
            return "near", self.words[near[0]], near[0]
        return None

    def of_token(self, token: str) -> tuple | None:
        """The heaviest hit among the words of a token (a run without white space, in lower case)."""
        if token in self.kept:
            return self.kept[token]
        found = max(filter(None, map(self.find, _WORDS(token))), key=lambda h: h[1], default=None)
        if len(token) <= 64:
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            self.kept[token] = found
        return found

    def hits(self, text: str) -> list[tuple[int, str, float, str, bool]]:
        """(position of the token, kind, weight, term, quoted) for each hit of a text."""
        tokens = text.lower().split()
        kept, of_token, out = self.kept, self.of_token, []
        for i, t in enumerate(tokens):
            hit = kept[t] if t in kept else of_token(t)
            if hit is not None:
                out.append((i, *hit, self.quoted(tokens, i)))
        return out

    @staticmethod
    def quoted(tokens: list[str], at: int) -> bool:
        """Does the window speak for quotation rather than abuse?"""
        before, after = tokens[max(0, at - WINDOW) : at], tokens[at + 1 : at + 1 + WINDOW]
        marks = sum(t.count(q) for t in before for q in QUOTES)
        own = tokens[at]
        inside = marks % 2 == 1 or (own[0] in QUOTES and own.rstrip(".,;:!?")[-1:] in QUOTES and len(own) > 1)
        words = {w for t in before + after for w in _WORDS(t)}
        return 2 * inside + bool(words & SAYING) > bool(words & SECOND_PERSON)

    def features(self, text: str) -> list[float]:
        hits = self.hits(text)
        open_ = [h for h in hits if not h[4]]
        kinds = Counter(h[1] for h in open_)
        weights = {h[3]: h[2] for h in open_}
        return [math.log1p(kinds["exact"]), math.log1p(kinds["near"]), math.log1p(kinds["stems"]),
                math.log1p(len(hits) - len(open_)), max(weights.values(), default=0.0),
                math.log1p(sum(weights.values()))]


class Model:
    def __init__(self, weights: dict[str, float], coefficients: list[float], intercept: float):
        self.weights, self.coefficients, self.intercept = weights, coefficients, intercept

    def scorer(self):
        lexicon = Lexicon(self.weights)

        def score(text: str | None) -> float:
            x = sum(a * b for a, b in zip(self.coefficients, lexicon.features(text or ""), strict=True))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, x + self.intercept))))

        return score


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """text, toxic and half (0 or 1) of at most ``rows`` labelled rows outside the held-out third; equal texts once."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    chosen = known.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` pairs of numbers: small enough to send to every executor, so no text is shuffled for this.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null")
    out = texts.groupBy(F.xxhash64("text").alias("hash")).agg(F.first("text").alias("text"),
                                                              F.max("toxic").alias("toxic"))
    return stable(out.select("text", "toxic", F.pmod("hash", F.lit(2)).cast("int").alias("half")), "labelled")


def terms_of(text: str) -> set[str]:
    words = set(_WORDS(text.lower()))
    return {w for w in words if len(w) >= 3} | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def learn_lexicon(rows: DataFrame, least_share: float = LEAST_SHARE) -> dict[str, float]:
    """Terms of toxic texts with their log odds, by counts of texts in ``rows`` (text, toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            seen = {0: Counter(), 1: Counter()}
            for text, toxic in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                seen[int(toxic > 0)].update(terms_of(text))
            for toxic, counts in seen.items():
                yield pa.RecordBatch.from_pydict(
                    {"term": pa.array(list(counts), pa.string()), "toxic": pa.array([toxic] * len(counts), pa.int32()),
                     "n": pa.array(list(counts.values()), pa.int64())})

    totals = {r[0]: r[1] for r in rows.groupBy((F.col("toxic") > 0).cast("int")).count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return {}
    counts = rows.select("text", "toxic").mapInArrow(count, "term string, toxic int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    a, b, all_ = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    odds = F.log((a + 0.5) / (pos + 1 - a)) - F.log((b + 0.5) / (neg + 1 - b))
    ratio = 2 * (a * F.log(a * (pos + neg) / (all_ * pos))
                 + F.when(b > 0, b * F.log(F.greatest(b, F.lit(1)) * (pos + neg) / (all_ * neg))).otherwise(0.0))
    good = counts.filter(a >= max(LEAST_TEXTS, math.ceil(least_share * pos))).select(
        "term", odds.alias("odds"), ratio.alias("ratio")).filter((F.col("odds") >= LEAST_ODDS)
                                                                 & (F.col("ratio") >= LEAST_RATIO))
    return {r.term: r.odds for r in good.orderBy(F.desc("ratio"), "term").limit(ENTRIES).collect()}


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled rows.  Without rows of both classes, the model scores every text alike, by the share
    of toxic labels (one half if there are none)."""
    rows = sample(docs, labels)
    weights = learn_lexicon(rows.filter("half = 0"))
    n, toxic = rows.agg(F.count("*"), F.sum((F.col("toxic") > 0).cast("long"))).first()
    base = ((toxic or 0) + 0.5) / (n + 1)
    flat = Model({}, [0.0] * len(FEATURES), math.log(base / (1 - base)))
    if not weights:
        return flat

    def make():
        lexicon = Lexicon(weights)
        return lambda batch: [[lexicon.features(t) for t in batch.column(0).to_pylist()]]

    fit_rows = add_columns(rows.filter("half = 1"), [F.col("text")], "x array<double>", make).select(
        array_to_vector("x").alias("features"), (F.col("toxic") > 0).cast("double").alias("label"))
    fit_rows = stable(fit_rows, "features")
    if fit_rows.select("label").distinct().count() < 2:
        return flat
    fit = LogisticRegression(regParam=0.005, maxIter=50).fit(fit_rows)
    return Model(weights, fit.coefficients.toArray().tolist(), float(fit.intercept))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts have no hits and get the score of such texts.  Rows are scored one by one, without a
    shuffle; the model (at most ``ENTRIES`` terms) travels with the task.
    """

    def make():
        of = model.scorer()

        def compute(batch: pa.RecordBatch) -> list:
            scores = [of(t) for t in batch.column(0).to_pylist()]
            return [scores, [int(s >= threshold) for s in scores]]

        return compute

    return add_columns(docs, [F.col("text")], "score double, predicted int", make)


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic; all columns stay."""
    columns = docs.columns
    marked = docs.select(*[F.col(f"`{c}`") for c in columns], F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_all"))
    scored = score(marked.select("_all", "text"), learn(docs, labels)).filter("predicted = 0")
    return scored.select(*[F.col("_all").getField(c).alias(c) for c in columns])
