"""Language identification by words first, backing off to shorter and shorter character n-grams.

Learning counts the words of all labelled texts outside the held-out third, by language, and the n-grams of those
words.  A word that is known in any language scores by its log frequency in each.  An unseen word scores by its
n-grams of the greatest length of which any is known, from five letters down to one.  A text adds up its words; the
prediction is the language with the highest sum, its score the share of that language after normalising.

Every learned word counts as known.  The most frequent words of all, at most ``WORDS``, are in memory, as an array
of hashes and one of log frequencies, and score where a text is read.  A text's other words, a few hundredths, leave
with their counts: they are made distinct, looked up in the table of all learned words by a join, or else scored by
their n-grams, once each, and their sums come back to the text.  The n-grams are those above the smallest count at which at most
``GRAMS`` of each length and language remain (found from a histogram of counts, not by sorting).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortwarn.llm.common import add_columns, held_out, slices, text_of
from cohortwarn.session import stable

#: Words in memory, n-grams of each length and language, longest n-gram, counters a task holds before passing them on.
WORDS, GRAMS, LONGEST, HELD = 200_000, 5_000, 5, 300_000
UNKNOWN = "und"

_LETTERS = regex.compile(r"\p{L}+").findall
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1) if n > 1 or padded[i] != " "]


def words_of(token: str) -> list[str]:
    """Runs of letters in lower case; what stands between white space is taken by itself."""
    low = token.lower()
    return [low] if low.isalpha() else _LETTERS(low)


class Tokens:
    """Texts cut at ASCII white space: the different tokens, and for each place its token and text."""

    def __init__(self, texts: pa.StringArray):
        at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        inside = ~_IS_SPACE[data]
        begun = np.zeros(len(data) + 1, bool)
        begun[at] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | begun[:-1]))
        upto = np.cumsum(inside)
        offsets = np.r_[upto[starts] - 1, upto[-1:]].astype(np.int32) if len(data) else np.zeros(1, np.int32)
        coded = pa.StringArray.from_buffers(
            len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        self.token = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.text = np.searchsorted(at, starts, "right") - 1


def _sent(rows: DataFrame, schema: str, columns: list[str], add) -> DataFrame:
    """lang, term, n: what ``add(held, batch)`` counts, ``held`` being counters by language."""

    def flush(held: dict[str, dict[str, int]]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(counts), pa.string()),
                                              "term": pa.array(list(counts), pa.string()),
                                              "n": pa.array(list(counts.values()), pa.int64())})
        held.clear()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {}
        for batch in slices(batches, 5000):
            add(held, batch)
            if sum(map(len, held.values())) > HELD:
                yield from flush(held)
        yield from flush(held)

    return rows.select(*columns).mapInArrow(work, schema).groupBy("lang", "term").agg(F.sum("n").alias("n"))


def add_words(held: dict[str, dict[str, int]], batch: pa.RecordBatch) -> None:
    tokens, langs = Tokens(batch.column(1)), batch.column(0).dictionary_encode()
    code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[tokens.text]
    size = max(1, len(tokens.names))
    known, counts = np.unique(code * size + tokens.token, return_counts=True)
    names, words = langs.dictionary.to_pylist(), [words_of(t) for t in tokens.names]
    for key, n in zip(known.tolist(), counts.tolist(), strict=True):
        of = held.setdefault(names[key // size], {})
        for word in words[key % size]:
            of[word] = of.get(word, 0) + n


def add_grams(held: dict[str, dict[str, int]], batch: pa.RecordBatch) -> None:
    for lang, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
        counts = held.setdefault(lang, {})
        get = counts.get
        for size in range(1, LONGEST + 1):
            for g in grams(word, size):
                counts[g] = get(g, 0) + n


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """Terms at or above the smallest count that leaves at most ``most`` of each language; ``total`` has all."""
    by = Window.partitionBy("lang").orderBy(F.desc("n"))
    levels = counts.groupBy("lang", "n").agg(F.count("*").alias("terms"))  # a row for each different count
    levels = levels.withColumn("kept", F.sum("terms").over(by)).withColumn(
        "total", F.sum(F.col("n") * F.col("terms")).over(Window.partitionBy("lang")))
    least = levels.groupBy("lang").agg(F.min(F.when(F.col("kept") <= most, F.col("n"))).alias("least"),
                                       F.first("total").alias("total"))
    return counts.join(least, "lang").filter(F.col("n") >= F.col("least")).select("lang", "term", "n", "total")


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


class Model:
    """Log frequencies in each language, of words in memory, of n-grams, and of all words as a table (word, vec)."""

    def __init__(self, languages: list[str], words: dict[str, list[float]], grams_: dict[str, list[float]],
                 table: DataFrame | None = None):
        self.languages, self.grams, self.table = languages, grams_, table
        names = list(words)
        order = np.argsort(found := hashes(names))
        self.hashes = found[order]
        self.vectors = np.array([words[n] for n in names], np.float64).reshape(len(names), len(languages))[order]

    def known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which words are in memory, and where."""
        found = hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, found), max(0, len(self.hashes) - 1))
        return (self.hashes[at] == found if len(self.hashes) else np.zeros(len(found), bool)), at

    def of_unseen(self, word: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            found = [self.grams[g] for g in grams(word, n) if g in self.grams]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.languages))

    def predictor(self):
        """A function from one text to (language, score); all words have to be in memory."""

        def predict(text: str | None) -> tuple[str, float]:
            sums, letters, rest = self.sums(pa.array([text or ""], pa.string()))
            if not self.languages or not letters[0]:
                return UNKNOWN, 0.0
            total = sums[0] + sum((n * self.of_unseen(w) for w, n in rest[0]), np.zeros(len(self.languages)))
            best = int(total.argmax())
            return self.languages[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())

        return predict

    def sums(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, list[list[tuple[str, int]]]]:
        """For each text the sums of its words in memory, whether it has a letter, and its other words with counts.

        Each different token is looked up once.
        """
        tokens, rows = Tokens(texts), len(texts)
        words = [words_of(t) for t in tokens.names]
        of = np.repeat(np.arange(len(words)), list(map(len, words)))
        flat = [w for ws in words for w in ws]
        known, at = self.known(flat)
        vectors = np.stack([np.bincount(of[known], self.vectors[at[known], j], len(words))
                            for j in range(len(self.languages))]) if self.languages else np.zeros((0, len(words)))
        sums = np.stack([np.bincount(tokens.text, v[tokens.token], rows) for v in vectors], 1) if len(vectors) else np.zeros((rows, 0))
        letter = np.zeros(len(words), bool)
        letter[of] = True
        letters = np.bincount(tokens.text[letter[tokens.token]], minlength=rows) > 0
        open_ = np.zeros(len(words), bool)
        open_[of[~known]] = True
        others: dict[int, list[str]] = {}
        for i, w in zip(of[~known].tolist(), [flat[i] for i in np.flatnonzero(~known).tolist()], strict=True):
            others.setdefault(i, []).append(w)
        left = np.flatnonzero(open_[tokens.token])
        pairs, counts = np.unique(tokens.text[left] * max(1, len(words)) + tokens.token[left], return_counts=True)
        rest: list[list[tuple[str, int]]] = [[] for _ in range(rows)]
        for pair, n in zip(pairs.tolist(), counts.tolist(), strict=True):
            rest[pair // len(words)] += [(w, n) for w in others[pair % len(words)]]
        return sums, letters, rest


def learn(docs: DataFrame, words: int = WORDS, grams_: int = GRAMS) -> Model:
    """A model from text and non-null lang of the rows outside the held-out third; without any, it knows nothing
    and predicts ``und``."""
    known = docs.filter(~held_out()).filter("lang is not null and text is not null")
    counted = "lang string, term string, n long"
    counts = stable(_sent(known, counted, ["lang", "text"], add_words), "words")
    pieces = stable(_sent(counts, counted, ["lang", "term", "n"], add_grams), "grams")
    # Languages without a learned word are left out.
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    languages = sorted(totals)
    # One floor for all languages: a language learned from less gains nothing on words it has not seen.
    floor = math.log(0.5 / (max(totals.values(), default=0) + 1))
    if not languages:
        return Model([], {}, {})

    def table(rows: DataFrame) -> dict[str, list[float]]:
        # At most so many rows for each language.
        place, out = {x: i for i, x in enumerate(languages)}, {}
        for r in rows.collect():
            out.setdefault(r.term, [floor] * len(languages))[place[r.lang]] = math.log((r.n + 0.5) / (r.total + 1))
        return out

    by_length = [table(frequent(pieces.filter(F.length("term") == n), grams_)) for n in range(1, LONGEST + 1)]
    of = F.map_from_entries(F.collect_list(F.struct("lang", "n")))
    sizes = F.create_map(*[F.lit(x) for item in totals.items() for x in item])
    vec = F.transform(F.array(*map(F.lit, languages)), lambda x: F.coalesce(
        F.log((F.col("of")[x] + 0.5) / (sizes[x] + 1)), F.lit(floor)))
    every = counts.groupBy("term").agg(of.alias("of"), F.sum("n").alias("n"))
    every = stable(every.select("term", "n", vec.alias("vec")), "all-words")
    # From a histogram of counts: the smallest count at which at most so many words remain.
    levels = every.groupBy("n").agg(F.count("*").alias("terms"))
    kept = F.sum("terms").over(Window.orderBy(F.desc("n")))
    least = levels.withColumn("kept", kept).filter(F.col("kept") <= words).agg(F.min("n")).first()[0]
    # At most ``words`` rows.
    memory = {} if least is None else {r.term: r.vec for r in every.filter(F.col("n") >= least).select("term", "vec").collect()}
    return Model(languages, memory, {k: v for t in by_length for k, v in t.items()}, every.select("term", "vec"))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) plus ``lang_pred`` and ``score`` (0 to 1), from the text alone.

    A null text, or one without a letter, gives ``und`` with score 0.  Rows are read once; only words that are not in
    memory are shuffled, added up by text.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    size, languages = len(model.languages), model.languages
    table, light = model.table, Model(languages, {}, model.grams)
    light.hashes, light.vectors = model.hashes, model.vectors
    sent = docs.sparkSession.sparkContext.broadcast(light)  # bounded by ``WORDS`` and ``GRAMS``

    def make():
        scorer = sent.value

        def compute(batch: pa.RecordBatch) -> list:
            sums, letters, rest = scorer.sums(batch.column(0))
            return [list(sums), letters, [[{"w": w, "n": n} for w, n in r] for r in rest]]

        return compute

    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(1).alias("_"))
    rows = docs.select(row.alias("row"), text_of().alias("text"))
    read = add_columns(rows, [F.col("text")], "sums array<double>, letters boolean, rest array<struct<w:string,n:long>>", make)
    read = stable(read.drop("text").withColumn("id", F.monotonically_increasing_id()), "read")
    left = read.select("id", F.inline("rest"))

    def make_grams():
        of = sent.value.of_unseen
        return lambda batch: [[of(w).tolist() if unseen else None for w, unseen in zip(*[c.to_pylist() for c in batch.columns], strict=True)]]

    if table is None:
        table = left.select(F.col("w").alias("term"), F.array().cast("array<double>").alias("vec")).limit(0)
    distinct = left.select("w").distinct().join(table.withColumnRenamed("term", "w"), "w", "left")
    scored = stable(add_columns(distinct, [F.col("w"), F.col("vec").isNull()], "other array<double>", make_grams).select(
        "w", F.coalesce("vec", "other").alias("vec")), "rest-words")
    added = left.join(scored, "w").groupBy("id").agg(F.array(*[
        F.sum(F.col("vec")[i] * F.col("n")) for i in range(size)]).alias("more"))
    both = read.drop("rest").join(added, "id", "left")
    total = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda a, b: a + b))
    both = both.withColumn("total", total).withColumn("best", F.array_max("total"))
    told = F.col("letters") & F.lit(size > 0)
    name = F.element_at(F.array(*map(F.lit, languages or [UNKNOWN])), F.array_position("total", F.col("best")).cast("int"))
    share = 1 / F.aggregate("total", F.lit(0.0), lambda acc, x: acc + F.exp(F.greatest(x - F.col("best"), F.lit(-700.0))))
    return both.select(*[F.col("row").getField(c).alias(c) for c in keep],
                       F.when(told, name).otherwise(UNKNOWN).alias("lang_pred"), F.when(told, share).otherwise(0.0).alias("score"))
