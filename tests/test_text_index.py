"""The stored index answers as postings made from the present texts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from speechlake.operators.retrieval import postings
from speechlake.operators.text_index import TextIndex


def rows(df) -> list:
    return sorted((r.speech_id, r.token, tuple(r.positions)) for r in df.collect())


def test_segments_replace_and_merge(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["é", "x2"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
    frame = lambda texts: spark.createDataFrame(list(texts.items()), "speech_id long, text string")
    terms = lambda *xs: spark.createDataFrame([(x,) for x in xs], "term string")
    index = TextIndex(spark, str(tmp_path / "index"), parts=8)
    assert index.live() == [] and index.lookup(terms("w1")).count() == 0
    batches = [{i: text() for i in range(120)}, {**{i: text() for i in range(80, 150)}, 5: None, 6: "", 7: "w1 " * 2_000}, {i: text() for i in range(0, 150, 3)}]
    now = {}
    some, many = terms("w1", "w2", "é", "w1", "unheard", None), terms(*words)
    for n, batch in enumerate(batches):
        index.append(n, frame(batch))
        now.update(batch)
        for asked in (some, many):
            assert rows(index.lookup(asked)) == rows(postings(frame(now), asked.where("term IS NOT NULL")))
    # a segment written again, and one whose writing was cut off before it was noted
    index.append(2, frame(batches[2]))
    spark.createDataFrame([(1, "w1", [0], 0)], "speech_id long, token string, positions array<int>, part int").write.partitionBy("part").parquet(str(tmp_path / "index/postings/segment=9"))
    want = rows(postings(frame(now), many))
    assert index.live() == [0, 1, 2] and rows(index.lookup(many)) == want
    index.merge(3)
    assert index.live() == [3] and rows(index.lookup(many)) == want
    index.append(4, frame({1: "w1 w2"}))
    now[1] = "w1 w2"
    assert rows(index.lookup(many)) == rows(postings(frame(now), many))
    # one term: the files of its part alone, its value in the scan
    found = index.lookup(terms("w1"))
    part = spark.range(1).select(index.part(F.lit("w1"))).first()[0]
    plan = found._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "positions" in line)
    assert "(part#" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and f"= {part})" in scan and "EqualTo(token,w1)" in scan
    assert index.lookup(terms()).count() == 0


def test_empty_segment(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"))
    index.append(0, spark.createDataFrame([], "speech_id long, text string"))
    assert index.lookup(spark.createDataFrame([("a",)], "term string")).count() == 0
    index.merge(1)
    assert index.lookup(spark.createDataFrame([("a",)], "term string")).count() == 0


def test_a_token_is_one_row_of_a_chunk(spark, tmp_path):
    """Each token of each text was a row, which was shuffled as such when it was indexed and when segments were merged."""
    said = spark.createDataFrame([(i, f" the car {i % 3} of the team!") for i in range(60)], "speech_id long, text string").coalesce(1)
    index = TextIndex(spark, str(tmp_path / "index"))
    index.append(0, said.where("speech_id < 40").coalesce(1))
    index.append(1, said.where("speech_id >= 30").coalesce(1))
    index.merge(2)
    stored = spark.read.parquet(str(tmp_path / "index/postings")).where("part >= 0")
    tokens = 7  # the, car, of, team, 0, 1, 2
    assert {r.segment: r["count"] for r in stored.groupBy("segment").count().collect()} == {0: tokens, 1: tokens, 2: 2 * tokens}
    asked = spark.createDataFrame([("the",), ("2",)], "term string")
    assert rows(index.lookup(asked)) == rows(postings(said, asked))


def test_many_chunks_of_many_segments(spark, tmp_path, monkeypatch):
    """Chunks of a few words, ids that are strings, tables that are too large to be broadcast; merged twice."""
    from speechlake.operators import text_index

    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    text = lambda: rng.choice(["", None, "-- ", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(9))])
    asked = spark.createDataFrame([(x,) for x in [*words, ""]], "term string")
    for limit, kind, key in ((0, "string", lambda i: f"k{i}"), (10**6, "long", lambda i: i)):
        monkeypatch.setattr(text_index, "MOST_BYTES", limit)
        index, now = TextIndex(spark, str(tmp_path / kind), parts=2, kind=kind, most=350), {}
        for n, ids in enumerate((range(60), range(0, 90, 2), None, range(0, 90, 3))):
            if ids is None:
                index.merge(n)
            else:
                batch = {key(i): text() for i in ids}
                index.append(n, spark.createDataFrame(list(batch.items()), f"speech_id {kind}, text string").coalesce(2))
                now.update(batch)
        want = rows(postings(spark.createDataFrame(list(now.items()), f"speech_id {kind}, text string"), asked))
        assert index.rows([0]).select("chunk").distinct().count() > 10
        assert rows(index.lookup(asked)) == want
        index.merge(4)
        assert index.live() == [4] and rows(index.lookup(asked)) == want
