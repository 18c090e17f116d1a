"""Repair of the structure of conversations by the cheapest list of edits.

A conversation is in order when the initials of its roles read ``(s?(ua)+)?``: nothing, or turns of user and assistant
in alternation behind one system turn at most.  Edits go from the first row to the last: Keep (free), Rerole to user or
assistant (2), Delete (3, required for blank and repeated rows), Insert an empty user or assistant turn (2).  A
truncated row that stays adds 1.  The edits are the arcs of a lattice whose nodes are (rows passed, last role); the
cheapest path is found by Dijkstra's search from both ends.  When no better meeting is possible, all crossings of the
least cost are known, and of the lists of edits through them the one with the least initials (ASCII) is taken.

Long conversations.  Rows are dealt out by ranges of (conversation, place) and cut into segments of at most
``SEGMENT`` rows, so no task holds a whole conversation.  For a segment the search gives the cost between each pair of
roles at its ends, and the order of their edit lists.  No list that ends with a row is the beginning of another from
the same node, so order among lists is settled in the first segment in which they differ: cost and order of few pairs
are enough to combine segments, first within a part of the table, then the parts.  Then each segment writes its edits
and repaired rows, which are digested in order as a stream.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwarn.llm.common import arrow_type
from cohortwarn.session import stable

REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Rows and characters of a segment.
SEGMENT, CHARACTERS = 256, 1_000_000
WHITE = " \t\n\v\f\r"

# Last role: nothing yet, system, user, assistant.  A conversation may end after the first and the last of them.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ENDS = (NOTHING, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}

# A row of the lattice: initial of the role, does it have to go, is it truncated.
Row = tuple[str, bool, bool]


def _onward(rows: list[Row], at: int, last: int, tail: bool):
    """Arcs out of a node: edit, cost, node."""
    for c, to in NEXT[last].items():
        if c != "s" and (at < len(rows) or tail):
            yield "I", INSERT, (at, to)
    if at < len(rows):
        initial, must_go, cut_off = rows[at]
        yield "D", DELETE, (at + 1, last)
        if not must_go:
            for c, to in NEXT[last].items():
                if c == initial:
                    yield "K", CUT_OFF * cut_off, (at + 1, to)
                if c != "s":
                    yield "R", REROLE + CUT_OFF * cut_off, (at + 1, to)


def _backward(rows: list[Row], at: int, last: int, tail: bool):
    """Arcs into a node: edit, cost, node."""
    for before in range(4):
        for edit, cost, node in _onward(rows, at, before, tail):
            if edit == "I" and node == (at, last):
                yield edit, cost, (at, before)
        if at:
            for edit, cost, node in _onward(rows, at - 1, before, tail):
                if edit != "I" and node == (at, last):
                    yield edit, cost, (at - 1, before)


def cheapest(rows: list[Row], first: int = NOTHING, goals: tuple[int, ...] = ENDS, tail: bool = True):
    """(cost, edits) from ``first`` before the rows to one of ``goals`` behind them; None if there is no way.

    ``tail``: turns may be inserted behind the last row.
    """
    n, start = len(rows), (0, first)
    ahead, back = {start: (0, "")}, {(n, g): 0 for g in goals}
    queue, queue_back = [], []
    done, done_back = dict(ahead), dict(back)
    best = 0 if start in back else None

    def forward(node: tuple[int, int]) -> None:
        nonlocal best
        cost, edits = done[node]
        for edit, price, to in _onward(rows, *node, tail):
            if to not in ahead or (cost + price, edits + edit) < ahead[to]:
                ahead[to] = cost + price, edits + edit
                heapq.heappush(queue, (cost + price, edits + edit, to))
            if to in done_back and (best is None or cost + price + done_back[to] < best):
                best = cost + price + done_back[to]

    def backward(node: tuple[int, int]) -> None:
        nonlocal best
        cost = done_back[node]
        for _, price, to in _backward(rows, *node, tail):
            if to not in back or cost + price < back[to]:
                back[to] = cost + price
                heapq.heappush(queue_back, (cost + price, to))
            if to in done and (best is None or cost + price + done[to][0] < best):
                best = cost + price + done[to][0]

    # Both ends are settled before the heaps start.
    forward(start)
    for node in list(done_back):
        backward(node)
    while queue and queue_back and (best is None or queue[0][0] + queue_back[0][0] <= best):
        if (queue[0][0], len(done)) <= (queue_back[0][0], len(done_back)):
            cost, edits, node = heapq.heappop(queue)
            if node not in done:
                done[node] = cost, edits
                forward(node)
        else:
            cost, node = heapq.heappop(queue_back)
            if node not in done_back:
                done_back[node] = cost
                backward(node)
    if best is None:
        return None
    # The least edits from each node of the far half to the end, the nearest to the end first.
    rest: dict[tuple[int, int], str | None] = {}
    for node in sorted(done_back, key=lambda x: (-x[0], done_back[x])):
        found = [""] if node[0] == n and node[1] in goals and done_back[node] == 0 else []
        for edit, price, to in _onward(rows, *node, tail):
            if done_back.get(to) == done_back[node] - price and rest.get(to) is not None:
                found.append(edit + rest[to])
        rest[node] = min(found, default=None)
    crossings = [rest[start]] if start in done_back and done_back[start] == best and rest[start] is not None else []
    for node, (cost, edits) in done.items():
        for edit, price, to in _onward(rows, *node, tail):
            if to in done_back and cost + price + done_back[to] == best and rest[to] is not None:
                crossings.append(edits + edit + rest[to])
    return best, min(crossings)


def apply_edits(edits: str, rows: list[Row], roles: list[str], texts: list[str], last: int = NOTHING) -> list[str]:
    """Repaired rows as ``role:text``."""
    out, at = [], 0
    for edit in edits:
        if edit == "D":
            at += 1
            continue
        c = rows[at][0] if edit == "K" else next(c for c in NEXT[last] if c != "s")
        out.append(f"{roles[at]}:{texts[at]}" if edit == "K" else f"{ROLES[c]}:" + (texts[at] if edit == "R" else ""))
        last = NEXT[last][c]
        at += edit != "I"
    return out


Matrix = dict[tuple[int, int], tuple[int, int]]  # (role before, role behind) -> cost, order of the edits


def matrix(rows: list[Row], final: bool) -> Matrix:
    out = {}
    for a in range(4):
        ends = [(NOTHING, ENDS)] if final else [(b, (b,)) for b in range(4)]
        found = {b: x for b, goals in ends if (x := cheapest(rows, a, goals, tail=final))}
        order = sorted(set(x[1] for x in found.values()))
        out.update({(a, b): (x[0], order.index(x[1])) for b, x in found.items()})
    return out


def combine(one: Matrix, two: Matrix) -> tuple[Matrix, dict[tuple[int, int], int]]:
    """The matrix of two segments in a row, and the role between them for each pair of ends."""
    out, between = {}, {}
    for a in range(4):
        found = {}
        for c in range(4):
            ways = [(one[a, b][0] + two[b, c][0], one[a, b][1], b) for b in range(4) if (a, b) in one and (b, c) in two]
            if ways:
                found[c] = min(ways)
        order = {c: (way[1], two[way[2], c][1]) for c, way in found.items()}
        ranks = sorted(set(order.values()))
        for c, way in found.items():
            out[a, c] = way[0], ranks.index(order[c])
            between[a, c] = way[2]
    return out, between


def chain(matrices: list[Matrix]) -> tuple[Matrix, list[dict[tuple[int, int], int]]]:
    whole, between = matrices[0], []
    for m in matrices[1:]:
        whole, b = combine(whole, m)
        between.append(b)
    return whole, between


def route(between: list[dict[tuple[int, int], int]], first: int, last: int) -> list[tuple[int, int]]:
    """Roles at both ends of each segment of a chain, given those at the ends of the chain."""
    out, end = [], last
    for b in reversed(between):
        mid = b[first, end]
        out.append((mid, end))
        end = mid
    return [(first, end), *reversed(out)]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy: the rows after damage.  Nulls in role and text, and in the key, are one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), blank))
    code = F.crc32(key.cast("binary")) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
                       code.alias("code")).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(copies).alias("copy"))


def _last_sign(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) plus ``fault``: blank, duplicate, truncated or null, the first that holds.

    A row is a duplicate of an earlier one with the same role and text, by turn (nulls first); rows of one turn follow
    each other by role and the digest of the text.
    """
    rows = stable(rows.withColumn("_digest", F.sha2("text", 256)).withColumn("_id", F.monotonically_increasing_id()), "turns")
    place = F.struct("turn", "_id")
    first = rows.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_digest").alias("_d")).agg(
        F.min(place).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_digest") == F.col("_d"))
    sign = _last_sign(F.col("text"))
    fault = (F.when(sign == "", "blank").when(~place.eqNullSafe(F.col("_first")), "duplicate")
             .when(~sign.isin(".", "!", "?"), "truncated"))
    return rows.join(first, same).withColumn("fault", fault).drop("_c", "_r", "_d", "_first")


SEGMENTS = ("conv_id {0}, part int, no int, inner boolean, initials array<string>, roles array<string>, texts array<string>, "
            "faults array<string>, turns long, first_turn long, last_turn long")


def segments(rows: DataFrame) -> DataFrame:
    """Rows with faults, cut into segments that are numbered by (part, no).

    ``inner``: the segment is a whole conversation, known because its part goes on behind and before it.
    """
    order = ["conv_id", "turn", "role", "_digest", "_id"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = SEGMENTS.format(rows.schema["conv_id"].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [arrow_type(f.dataType) for f in T._parse_datatype_string(schema)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, held, out, size = TaskContext.get().partitionId(), 0, [], [], [0, 0]
        # Did the conversation at hand begin in this part, behind another one?
        begun = False

        def close(inner: bool) -> None:
            nonlocal no
            convs, turns, roles, texts, found = zip(*held, strict=True)
            known = [t for t in turns if t is not None]
            out.append((convs[0], part, no, inner, [r[:1] for r in roles], roles, texts, found, len(set(known)),
                        known[0] if known else None, known[-1] if known else None))
            no += 1
            held.clear()
            size[:] = 0, size[0] + size[1]

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            size[1] = 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and row[0] != held[0][0]:
                    close(begun)
                    begun = True
                elif len(held) >= SEGMENT or size[0] >= CHARACTERS:
                    close(False)
                    begun = False
                held.append(row)
                size[0] += len(row[3])
                if size[1] >= CHARACTERS:
                    yield batch_of()
        if held:
            close(False)
        if out:
            yield batch_of()

    return dealt.select("conv_id", "turn", "role", "text", "fault").mapInArrow(work, schema)


def _rows(initials, found) -> list[Row]:
    return [(c, f in ("blank", "duplicate"), f == "truncated") for c, f in zip(initials, found, strict=True)]


COUNTED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


class Summary:
    """Counts and digest of a conversation, segment by segment."""

    def __init__(self):
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.turns, self.first, self.last, self.before = 0, 0, None, None, None
        self.audit, self.sha, self.empty = [], hashlib.sha256(), True

    def add(self, initials, found, turns, first, last, edits: str, repaired: str | None) -> None:
        for f in found:
            if f:
                self.counts[f] += 1
        for a, b in zip([self.before, *initials], initials, strict=False):
            self.illegal += a is not None and a + b not in LEGAL
        self.before = initials[-1]
        if first is not None:
            self.turns += turns - (first == self.last)
            self.first = first if self.first is None else self.first
            self.last = last
        self.audit.append(edits)
        if repaired is not None:
            self.sha.update(("" if self.empty else "\n").encode() + repaired.encode("utf-8", "surrogatepass"))
            self.empty = False

    def row(self, cost: int) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (gaps, *self.counts.values(), self.illegal, cost, "".join(self.audit), self.sha.hexdigest())


def _whole(pieces: DataFrame, conv: str) -> DataFrame:
    """Results of conversations that are one segment."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x in pdf.itertuples(index=False):
                rows = _rows(x.initials, x.faults)
                cost, edits = cheapest(rows)
                lines = apply_edits(edits, rows, x.roles, x.texts)
                s = Summary()
                s.add(x.initials, x.faults, x.turns, _int(x.first_turn), _int(x.last_turn), edits,
                      "\n".join(lines) if lines else None)
                out.append(s.row(cost))
            yield pd.DataFrame(out, columns=names).assign(conv_id=pdf["conv_id"].to_numpy())[["conv_id", *names]]

    names = [x.split()[0] for x in COUNTED.split(", ")]
    return _nullable(pieces, work, conv)


def _int(x) -> int | None:
    return None if x is None or x != x else int(x)


def _nullable(pieces: DataFrame, work, conv: str) -> DataFrame:
    """``work`` over pandas frames in which conv_id is text, so that null and large ids stay what they are."""
    rows = pieces.withColumn("conv_id", F.col("conv_id").cast("string"))
    for c in ("first_turn", "last_turn"):
        rows = rows.withColumn(c, F.col(c).cast("string"))
    done = rows.mapInPandas(work, f"conv_id string, {COUNTED}")
    return done.withColumn("conv_id", F.col("conv_id").cast(conv))


def _composed(pieces: DataFrame, conv: str) -> DataFrame:
    """Results of conversations in several segments, or at the edge of a part."""
    pieces = pieces.withColumn("conv", F.coalesce(F.to_json(F.struct("conv_id")), F.lit("")))
    ends = pieces.groupBy("conv").agg(F.max(F.struct("part", "no")).alias("end"))
    pieces = stable(pieces.join(ends, "conv").withColumn("final", F.struct("part", "no") == F.col("end")).drop("end"), "cut")
    cells = "array<struct<a:int,b:int,cost:long,rank:int>>"

    def pack(m: Matrix) -> list[dict]:
        return [{"a": a, "b": b, "cost": c, "rank": r} for (a, b), (c, r) in m.items()]

    def unpack(found) -> Matrix:
        return {(x["a"], x["b"]): (x["cost"], x["rank"]) for x in found}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [pack(matrix(_rows(i, f), final)) for i, f, final in
                     zip(pdf["initials"], pdf["faults"], pdf["final"], strict=True)]
            yield pdf[["conv", "part", "no"]].assign(cells=found)

    small = stable(pieces.select("conv", "part", "no", "initials", "faults", "final").mapInPandas(
        solve, f"conv string, part int, no int, cells {cells}"), "matrices")

    # A group is what one part holds of a conversation, then one row for each part of a conversation.
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, _ = chain([unpack(x) for x in pdf.sort_values("no")["cells"]])
        return pdf[["conv", "part"]].head(1).assign(cells=[pack(whole)])

    parts = small.groupBy("conv", "part").applyInPandas(fold, f"conv string, part int, cells {cells}")

    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        whole, between = chain([unpack(x) for x in pdf["cells"]])
        ways = route(between, NOTHING, NOTHING)
        return pdf[["conv", "part"]].assign(before=[a for a, _ in ways], behind=[b for _, b in ways],
                                            cost=whole[NOTHING, NOTHING][0])

    ends = parts.groupBy("conv").applyInPandas(over, "conv string, part int, before int, behind int, cost long")

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        _, between = chain([unpack(x) for x in pdf["cells"]])
        ways = route(between, int(pdf["before"].iloc[0]), int(pdf["behind"].iloc[0]))
        return pdf[["conv", "part", "no", "cost"]].assign(before=[a for a, _ in ways], behind=[b for _, b in ways])

    routes = small.join(stable(ends, "ends"), ["conv", "part"]).groupBy("conv", "part").applyInPandas(
        down, "conv string, part int, no int, cost long, before int, behind int")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            edits, lines = [], []
            for x in pdf.itertuples(index=False):
                rows = _rows(x.initials, x.faults)
                goals, tail = (ENDS, True) if x.final else ((int(x.behind),), False)
                edits.append(cheapest(rows, int(x.before), goals, tail)[1])
                found = apply_edits(edits[-1], rows, x.roles, x.texts, int(x.before))
                lines.append("\n".join(found) if found else None)
            keep = ["conv", "conv_id", "part", "no", "final", "initials", "faults", "turns", "first_turn", "last_turn", "cost"]
            yield pdf[keep].assign(edits=edits, repaired=lines)

    texts = pieces.join(routes, ["conv", "part", "no"]).withColumn("conv_id", F.col("conv_id").cast("string"))
    for c in ("first_turn", "last_turn"):
        texts = texts.withColumn(c, F.col(c).cast("string"))
    written = stable(texts.mapInPandas(
        write, "conv string, conv_id string, part int, no int, final boolean, initials array<string>, faults array<string>, "
        "turns long, first_turn string, last_turn string, cost long, edits string, repaired string"), "edited")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, names = Summary(), ["conv_id", *[x.split()[0] for x in COUNTED.split(", ")]]
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                x = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                s.add(x["initials"], x["faults"], x["turns"], _int(x["first_turn"]), _int(x["last_turn"]), x["edits"], x["repaired"])
                if x["final"]:
                    out.append((x["conv_id"], *s.row(x["cost"])))
                    s = Summary()
            if out:
                kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    done = written.repartition("conv").sortWithinPartitions("conv", "part", "no").mapInArrow(digest, f"conv_id string, {COUNTED}")
    return done.withColumn("conv_id", F.col("conv_id").cast(conv))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    ``rows`` has conv_id, turn, role and text; other columns are not read.  Rows count by turn, nulls first, then role
    and digest of the text.  Null roles and texts count as one space.  ``gaps`` are turns that are missing between the first and the
    last, ``illegal`` neighbours in the wrong order.  A row whose role is empty cannot be kept as it is.  Repeated rows
    are duplicates; a null conv_id is a conversation of its own; an empty table gives no rows.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"))
    pieces = stable(segments(faults(rows)), "segments")
    alone = _whole(pieces.filter("inner"), conv)
    return alone.unionByName(_composed(pieces.filter("not inner"), conv))


def repair_damaged(rows: DataFrame) -> DataFrame:
    """What :func:`repair` gives for the rows after :func:`damage`, for every conversation of ``rows``: one without a
    row left has zeros, an empty audit and the digest of the empty text."""
    ids = rows.select("conv_id").distinct()
    found = repair(damage(rows)).withColumnRenamed("conv_id", "_found")
    both = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return both.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                       F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
