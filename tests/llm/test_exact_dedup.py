import hashlib
from collections import defaultdict

import pytest
from llm.conftest import plan, read
from oracle import connect, differences
from pyspark.sql import functions as F

from cohortwarn.llm import exact_dedup
from cohortwarn.llm.queries import QUERIES, SQL
from cohortwarn.session import new_folder


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        norm = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        groups[norm].append(r[0])
    out = []
    for norm, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def collect(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "text_sha256").collect()), key=repr)


def test_odd_rows(odd, clashing, empty, odd_rows):
    for docs in (odd, clashing):
        found = exact_dedup.mark_copies(docs)
        assert collect(found) == brute(odd_rows)
        kept = found.filter("kept").groupBy("text_sha256").count()
        assert {r["count"] for r in kept.collect()} == {1}  # one row of each group, also where rows repeat
        assert kept.count() == len({b[3] for b in brute(odd_rows)})
    assert exact_dedup.mark_copies(empty).count() == 0


def test_digests_that_collide_are_told_apart_by_the_bytes(spark, small, odd, odd_rows):
    short = lambda text: F.substring(F.sha2(text, 256), 1, 1).cast("binary")
    assert collect(exact_dedup.mark_copies(odd, digest=short)) == brute(odd_rows)
    one = lambda text: F.lit("same").cast("binary")
    rows = read(spark, small).collect()
    assert collect(exact_dedup.mark_copies(read(spark, small), digest=one)) == brute(rows)


def test_state_goes_on_with_new_arrivals(spark):
    folder = new_folder(spark, "test-arrivals")

    def arrive(rows):
        df = spark.createDataFrame(rows, "digest string, doc_id long, file long, row long").withColumn(
            "digest", F.col("digest").cast("binary"))
        df.select("digest", "doc_id", "file", "row").write.mode("append").parquet(f"{folder}/arrivals")
        found = exact_dedup.add_arrivals(spark, f"{folder}/arrivals", f"{folder}/state")
        return sorted((bytes(r.digest).decode(), r.doc_id, r.n) for r in found.collect())

    assert arrive([("a", 1, 0, 0), ("b", 5, 0, 1), ("a", 3, 0, 2)]) == [("a", 3, 2), ("b", 5, 1)]
    assert arrive([("b", 2, 1, 0), ("c", 9, 1, 1), ("a", 7, 1, 2)]) == [("a", 7, 3), ("b", 5, 2), ("c", 9, 1)]
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"  # settings are put back


def test_kept_rows(odd, clashing, empty, odd_rows):
    left = exact_dedup.drop_copies(clashing)
    assert left.columns == clashing.columns
    assert left.count() == len({b[3] for b in brute(odd_rows)})
    assert exact_dedup.drop_copies(empty).count() == 0


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_query(spark, size):
    path = f"/root/testdata/sf{size}"
    found = QUERIES["op1_exact_dedup"](spark, path)
    assert "Python" not in plan(found) and "Arrow" not in plan(found)
    assert differences(found, connect(path), SQL["op1_exact_dedup"]) == ""


def test_rows_multiplied_above_a_scan(spark, small):
    """A scan below an explode or a join gives many rows with one place."""
    docs = read(spark, small)
    texts = docs.selectExpr("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t")
    twice = docs.selectExpr("*", "explode(array(1, 2)) as i").drop("i")
    marked = exact_dedup.mark_copies(twice)
    assert marked.count() == 2 * docs.count()
    assert marked.filter("kept").count() == texts.distinct().count() == exact_dedup.drop_copies(twice).count()
    joined = docs.join(spark.range(3).withColumnRenamed("id", "n"), exact_dedup.F.lit(True)).drop("n")
    assert exact_dedup.drop_copies(joined).count() == texts.distinct().count()


def test_a_bare_scan_is_read_where_it_is(spark, small):
    docs = read(spark, small)
    assert exact_dedup.scanned(docs) is docs and exact_dedup.scanned(docs.filter("doc_id > 3")) is not docs
