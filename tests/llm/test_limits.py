"""What tasks hold and how often they work, where a limit was broken."""

import random

import numpy as np
import pyarrow as pa

from slidecast.llm import blocks, common, decontam, graph, ngram_join, toxicity


def test_a_carried_text_is_sent_once(spark, monkeypatch):
    sent, measured = [], toxicity._measured
    monkeypatch.setattr(toxicity, "_measured", lambda rows, *a: sent.append(rows) or measured(rows, *a))
    rows = [(i, None if i == 7 else f"{'bad' if i % 3 == 0 else 'good'} word number {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    want = {r.doc_id: r for r in toxicity.toxicity_scores(df, labels).collect()}
    got = toxicity.toxicity_scores(df, labels, carry=["text", "doc_id"])
    assert [t for _, t in sent[-1].dtypes].count("string") == 1
    assert got.columns == ["text", "doc_id", "__toxicity"]
    for r in got.collect():
        judged = r["__toxicity"]
        assert r.text == rows[r.doc_id][1]
        assert (judged.held_out, judged.score, judged.predicted) == (want[r.doc_id].held_out, want[r.doc_id].score, want[r.doc_id].predicted)
    numbers = df.selectExpr("doc_id", "doc_id AS text")  # a text that is no string is read as one and carried as it is
    assert {(r.doc_id, r.text) for r in toxicity.toxicity_scores(numbers, labels, carry=["doc_id", "text"]).collect()} == {(i, i) for i in range(200)}


def test_word_hashes_keep_no_memo():
    hasher = common.WordHasher()
    h = hasher.of([b"a", b"b", b"a", b""])
    assert h.dtype == np.uint64 and h[0] == h[2] != h[1] and not isinstance(hasher, dict) and not vars(hasher)


def test_tasks_get_few_texts_at_a_time(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    sizes = lambda batches: (pa.record_batch([pa.array([b.num_rows])], names=["n"]) for b in batches)
    df = spark.range(0, 3 * common.BATCH_ROWS, 1, 1).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    before = spark.conf.get(key)
    try:
        for operator in (ngram_join.jaccard_links, lambda x: decontam.remove_contamination(x, df.limit(1).withColumnRenamed("doc_id", "item_id")),
                         lambda x: toxicity.toxicity_scores(x, df.selectExpr("doc_id", "1 AS toxic"))):
            spark.conf.set(key, before)
            operator(df.limit(5))
            assert max(r.n for r in df.mapInArrow(sizes, "n long").collect()) <= common.BATCH_ROWS
        spark.conf.set(key, "7")  # a lower bound stays
        common.few_texts(spark)
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)


def test_cleaning_takes_one_worker_a_task(spark):
    rows = [(i, f"some words before {'the item that leaked here ' * (i % 2)}and words after {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the item that leaked here"), (2, "nowhere")], "item_id long, text string")
    for options, steps in (({}, 1), ({"block_bytes": 10}, 2)):
        out = decontam.remove_contamination(df, bench, **options)
        assert out.schema == df.schema
        assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == steps
        assert {(r.doc_id, r.text) for r in out.collect()} == {
            (i, f"some words before {' ' * (i % 2)}and words after {i}") for i in range(20)}


def test_the_usual_count_of_a_sketch():
    order = np.random.default_rng(2).integers(0, 40, 3 * ngram_join.SKETCH_CHUNK + 5).astype(np.uint8)
    counts = ngram_join.sketch_counts()
    assert ngram_join.usual_count(order, counts) == float((np.bincount(order, minlength=256) * counts).sum() / len(order))


def test_rounds_of_the_star_join_send_no_table_to_the_driver(spark, monkeypatch):
    plans = []
    for module in (graph, blocks):
        monkeypatch.setattr(module, "materialize", lambda df, kind, *a, write=module.materialize: plans.append(
            (kind, df._jdf.queryExecution().executedPlan().toString())) or write(df, kind, *a))
    links = [(i, i + 1) for i in range(1, 30)] + [(100 + i, 100) for i in range(1, 9)] + [(7, 7), (None, 5), (200, 201), (200, 201)]
    got = {tuple(r) for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 1) for i in range(1, 31)} | {(i, 100) for i in range(100, 109)} | {(200, 200), (201, 200)}
    comps = graph.components(spark.createDataFrame([(1, 2), (3, 4), (8, 9)], "a long, b long"))
    united = blocks._united(comps, spark.createDataFrame([(2, 4), (4, 6)], "a long, b long"), "test")
    assert {tuple(r) for r in united.collect()} == {(i, 1) for i in (1, 2, 3, 4, 6)} | {(8, 8), (9, 8)}
    plans.append(("members", blocks._with_members(spark.createDataFrame([(1, 2), (1, 3)], "hub long, node long"))._jdf.queryExecution().executedPlan().toString()))
    assert {"star-0", "star-1", "test-components", "members"} <= {kind for kind, _ in plans}
    assert [kind for kind, plan in plans if "Broadcast" in plan] == []


def test_a_round_of_the_star_join_deals_its_links_few_times(spark, monkeypatch):
    plans, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, kind, *a: plans.append(
        (kind, df._jdf.queryExecution().executedPlan().toString())) or write(df, kind, *a))
    rng, links = random.Random(3), []
    for i in range(300):  # chains, stars and tangles of 1 to 30 nodes with ids in no order
        ids = rng.sample(range(i * 1000, i * 1000 + 1000), rng.randint(2, 30))
        links += [(b, a) if rng.random() < 0.5 else (a, b) for a, b in zip(ids, ids[1:])] if i % 3 else [(ids[0], x) for x in ids[1:]]
        links += [tuple(rng.choices(ids, k=2)) for _ in range(i % 7)]
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    rounds = [plan for kind, plan in plans if kind != "star-0"]
    assert rounds and all(plan.count("Union") == 2 for plan in rounds)  # links and their reverse, for each of the two reads
