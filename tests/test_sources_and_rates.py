"""File inventories, logs, rates by spans of time, and functions that no query shows alone."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import metadata as D
from quern.functions import money as M
from quern.operators import evaluate as E
from quern.operators import fusion as U
from quern.sources import tables as S


def values(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(column(F.col("t"))).collect()]


def test_only_changed_files_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "NAMES", 2)
    for k in range(5):
        (tmp_path / f"{k}.txt").write_text(f"text {k}")
    first = S.file_inventory(spark, str(tmp_path))
    first = spark.createDataFrame(first.collect(), first.schema)
    assert first.count() == S.file_listing(spark, str(tmp_path)).count() == 5
    for k in (1, 3, 4, 7):
        (tmp_path / f"{k}.txt").write_text(f"other {k}!")
    os.remove(tmp_path / "0.txt")
    seen = []
    whole = S.file_inventory
    monkeypatch.setattr(S, "file_inventory", lambda spark, names: seen.append(sorted(os.path.basename(n) for n in names)) or whole(spark, names))
    now = S.updated_inventory(spark, str(tmp_path), first)
    assert sorted(x for names in seen for x in names) == ["1.txt", "3.txt", "4.txt", "7.txt"] and all(len(n) <= 2 for n in seen)
    plain = lambda df: sorted((os.path.basename(r["path"]), r["size"], r["hash"]) for r in df.collect())
    assert plain(now) == plain(whole(spark, str(tmp_path)))


def test_routing_log(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02"):
        (tmp_path / f"routing_{day}.jsonl").write_text(json.dumps({"timestamp": f"{day}T01:02:03", "query": "q", "mode": "QA", "reason": "r", "confidence": 0.5}) + "\n")
    assert [(r["timestamp"][:10], r["confidence"]) for r in S.routing_log(spark, str(tmp_path)).orderBy("timestamp").collect()] == [("2024-01-01", 0.5), ("2024-01-02", 0.5)]


@pytest.mark.parametrize("span", [1, 7, 3600])
def test_rate_is_that_of_one_event_after_another(spark, span):
    rng = random.Random(span)
    rows = [(g, round(rng.uniform(0, 400), 3)) for g in ("a", "b", None) for _ in range(60)] + [("one", 5.0), ("two", 5.0), ("two", 5.0)]
    wanted = {}
    for g in ("a", "b", None, "one", "two"):
        rate, last = 0.0, None
        for t in sorted(t for x, t in rows if x == g):
            dt = 1e-6 if last is None else max(t - last, 1e-6)
            rate += (1 - math.exp(-dt / 60)) * (1 / dt - rate)
            last = t
        wanted[g] = rate
    events = spark.createDataFrame(rows, "g string, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")))
    found = {r["g"]: (r["n"], r["rate"]) for r in E.ewma_rate(events, "g", "ts", span=span).collect()}
    assert {g: n for g, (n, _) in found.items()} == {"a": 60, "b": 60, None: 60, "one": 1, "two": 2}
    assert all(abs(found[g][1] - x) < 1e-6 for g, x in wanted.items())


def test_words_of_queries_and_money(spark):
    row = spark.createDataFrame([("LVM-180A 렌즈 교체 1,200원 김하늘",)], "t string").select(*[c.alias(n) for n, c in U.query_keywords(F.col("t")).items()]).first()
    assert row["models"] == ["LVM-180A"] and "1,200원" in row["amounts"] and row["names"] == ["김하늘"]
    assert [r[0] for r in spark.createDataFrame([(1234567,), (None,)], "a bigint").select(M.format_won(F.col("a"))).collect()] == ["1,234,567원", None]
    assert values(spark, D.largest_money, "합계: 3,000,000원 그리고 1,500원", "없음")[0] == 3_000_000


def test_a_changed_table_gets_a_new_index(spark, tmp_path):
    from quern.operators import retrieval as R

    path = str(tmp_path / "documents.parquet")
    found = []
    for text in ("one two", "six two"):  # of the same size
        spark.createDataFrame([(1, text)], "doc_id bigint, text string").coalesce(1).write.mode("overwrite").parquet(path)
        index = R.stored_index(spark.read.parquet(path), path)
        assert R.stored_index(spark.read.parquet(path), path).terms.count() == 2
        found.append(sorted(r["term"] for r in index.terms.collect()))
    assert found == [["one", "two"], ["six", "two"]]
