"""Plans that must stay bounded as tables grow."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechlake.operators import joins as j


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_many_aliases_and_drivers_are_not_broadcast(spark):
    said = spark.createDataFrame([(i, f"car {i} and Car {i + 1}!", i % 3) for i in range(40)], "speech_id long, text string, session_key long")
    aliases = spark.range(2000).select(F.concat(F.lit("car "), "id").alias("alias"), F.lit("driver").alias("entity_type"), F.col("id").cast("string").alias("entity_key"))
    drivers = spark.range(2000).select((F.col("id") % 3).alias("session_key"), F.col("id").alias("driver_number"), F.lit("x").alias("name"))
    found = j.session_drivers(j.mentions(said, aliases, most_broadcast=100), said, drivers)
    # the one first word is broadcast, the 2,000 aliases and drivers meet by sorting
    assert plan_of(found).count("BroadcastHashJoin") <= 2
    assert {(x.speech_id, x.driver_number) for x in found.collect()} == {(i, n) for i in range(40) for n in (i, i + 1) if n % 3 == i % 3}


def test_calls_are_distinct_before_names_are_joined(spark):
    """Rows that unfold in a task are dealt by their number; repeated rows of any table make one call."""
    from speechlake.sources.adapters import Tables

    sf = "/root/testdata/sf0.001"
    t = Tables(spark, sf)
    twice = {name: t.raw(name).unionByName(t.raw(name)) for name in ("lineitem", "orders", "part")}
    calls = t.v_radio
    assert "RepartitionByExpression" in calls._jdf.queryExecution().optimizedPlan().toString()
    assert calls._jdf.queryExecution().optimizedPlan().toString().index("Join") < calls._jdf.queryExecution().optimizedPlan().toString().index("Aggregate")
    again = t.replaced(**twice).v_radio
    assert calls.count() == again.count() > 0
    assert again.exceptAll(calls).isEmpty()


def test_dealt_rows_take_tasks_by_their_number(spark):
    from speechlake.operators.shared import ROWS_OF_A_TASK, dealt

    assert dealt(spark.range(10), 5 * ROWS_OF_A_TASK, "id").rdd.getNumPartitions() == 5
    assert dealt(spark.range(10), 0, "id").rdd.getNumPartitions() == 1


def test_neighbourhoods_do_not_read_speech_again(spark):
    """What surrounds asked speech is made of the stored speech: the table that calls and utterances come from is not read."""
    from speechlake.operators import context
    from speechlake.operators.shared import stored
    from speechlake.sources.adapters import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    speech = stored(context.speech_lines(t))
    ids = stored(speech.orderBy("speech_id").limit(9).unionByName(speech.orderBy(F.desc("speech_id")).limit(9)).select("speech_id").distinct())
    broken = t.lineitem.select(*(F.raise_error(F.lit("read again")).cast(f.dataType).alias(f.name) for f in t.lineitem.schema))
    got = context.neighbourhood(t.replaced(lineitem=broken), ids, speech)
    assert {x.speech_id for x in got.collect()} == {x.speech_id for x in ids.collect()}


def test_whole_postings_shuffle_texts_and_not_words(spark):
    """Words are cut where their text has arrived; ids that stand twice still make one row for each word."""
    from speechlake.operators import retrieval as r

    said = spark.createDataFrame([(1, "a b A"), (2, None), (1, "b c"), (3, "")], "speech_id long, text string")
    index = r.postings(said)
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Repartition")
    physical = index._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange") == 1
    assert {(x.speech_id, x.token): x.positions for x in index.collect()} == {(1, "a"): [0, 2], (1, "b"): [0, 1], (1, "c"): [1]}


def test_vectors_of_many_keys_stay_whole_rows(spark):
    """A vector went to the sums of its key number by number, each with the key beside it."""
    from speechlake.functions.vectors import mean_direction, weighted_centroid

    rows = spark.createDataFrame([(1, "a", [3.0, 0.0, None]), (1, "a", [0.0, 4.0, 0.0]), (1, "b", [0.0, 0.0, 0.0]), (2, "a", [0.0, 0.0, 2.0])], "clip_id long, half string, vec array<double>")
    made = mean_direction(rows, ["clip_id", "half"], "vec", 3, 2)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
    got = {(x.clip_id, x.half): x.centroid for x in made.collect()}
    assert got == {(1, "a"): [0.6, 0.8, 0.0], (1, "b"): None, (2, "a"): [0.0, 0.0, 1.0]}
    key = F.struct("clip_id", "half")
    assert got == {tuple(x.k): x.centroid for x in weighted_centroid(rows.withColumns({"k": key, "one": F.lit(1.0)}), "k", "vec", "one").collect()}


def test_summary_reads_shared_views_as_they_were_written(spark, tmp_path):
    """Each of 31 parts made the views of lineitem anew; stored views are made of those stored before them."""
    from speechlake.operators import graph as g
    from speechlake.sources.adapters import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    assert "l_orderkey" not in plan_of(g.summary(t, str(tmp_path / "one")))
    base = t.stored(("v_clip_speakers",), str(tmp_path / "two"))
    lost = base.replaced(v_clip_speakers=base.v_clip_speakers.limit(0))
    assert lost.stored(("v_speech_utt",), str(tmp_path / "three")).v_speech_utt.isEmpty()
    written = t.stored(("v_clip_speakers", "v_speech_utt"), str(tmp_path / "four"))
    assert written.v_speech_utt.exceptAll(t.v_speech_utt).isEmpty() and written.v_speech_utt.count() == t.v_speech_utt.count()


def test_sure_ends_are_not_made_again(spark):
    """Nodes of an edge's own rows were built a second time to be looked up: calls were made of lineitem for the mentions' edges, their texts and their ends."""
    from speechlake.operators import graph as g
    from speechlake.sources.adapters import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    # half of the races, drivers, speakers and sessions are missing, and no edge may point at them
    t = t.replaced(customer=t.customer.where("c_custkey % 2 = 0"), supplier=t.supplier.where("s_suppkey % 3 > 0"), nation=t.nation.where("n_nationkey % 2 = 0"))
    edges = {p.name: p for p in g.EDGES}
    assert "l_orderkey" not in plan_of(g.landed(t, edges["MENTIONS"]))
    for name in ("IN_CLIP", "SPOKEN_BY", "UTT_NEXT", "IN_RACE", "PART_OF", "DROVE_IN", "CALL_BY_DRIVER", "LAP_NEXT", "DURING_LAP", "READS_AS", "INVOLVES", "MENTIONS"):
        p = edges[name]
        rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
        every = rows(j.land_edges(p.build(t), *(g.ENDS[e](t) for e in p.ends)))
        assert rows(g.landed(t, p)) == every and every, name


def test_counted_positions_are_ranked_in_tasks_by_their_number(spark, monkeypatch):
    """The tasks that sort positions were as many as the session shuffles by, whatever the index."""
    from speechlake.operators import retrieval as r
    from speechlake.operators import shared

    monkeypatch.setattr(shared, "ROWS_OF_A_TASK", 20)
    said = spark.createDataFrame([(i, "a b c a d b " * (i % 4)) for i in range(40)], "speech_id long, text string")
    terms = spark.createDataFrame([(1, 1, "all", "a", 0), (1, 2, "any", "d", 0), (2, 1, "all", "b", 0)], "request_id long, clause_id long, kind string, term string, offset int")
    index = r.postings(said)
    ranks = r.cover_rank(index, terms, counted=True)
    assert "REPARTITION_BY_NUM" in plan_of(ranks) and ranks.rdd.getNumPartitions() == 60 * 5 // 20
    assert sorted(map(tuple, ranks.collect())) == sorted(map(tuple, r.cover_rank(index, terms).collect()))
    assert r.cover_rank(index.limit(0), terms, counted=True).isEmpty()
