"""Cases of the last review: random texts, repeated ids, hot hosts, clashing and dotted names, the list of queries without SQL."""

import random
import re

import pytest
from pyspark.sql import functions as F

from slidecast.llm import decontam, lines, mixing, ngram_join, queries, secrets, toxicity
from slidecast.llm.common import alnum_words

# Queries whose results SQL cannot express; each has a brute-force, round-trip or held-out test here.
WITHOUT_SQL = {"op4_toxicity", "op5_secret_scan", "op6_sharding", "op8_substring_dedup", "op9_mixing",
               "op11_pii", "op12_periodic_runs", "op13_whitening"}


def test_every_query_has_an_oracle_or_is_listed():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) - set(queries.ORACLES) == WITHOUT_SQL
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and "pipeline" not in entry.oracle_sql()


TOKENS = ["password=", "token : '", "api_key=\"", "SECRET:", "secret", "=", ":", " ", "\n", "é", "AKIA", "ABCDEFGHIJKLMNOP1234", "akia",
          "0123456789abcdef01234567", "deadbeef", "abc", "x.y_z-", "passwd  =  ", "KEY", "apikey:", "\U0001F511", "/+"]


def brute_base(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_equal_brute_force_and_ownership_counts(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(TOKENS) for _ in range(rng.randrange(14))), rng.choice(["en", None]), rng.choice(["a", "b", "c", "d", None])) for i in range(500)]
    rows += [(3, rows[3][1], "en", "a"), (None, None, None, None), (600, "token=" + "q" * 300_000, "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = secrets.find_secrets(df).select("doc_id", secrets.spelled("base").alias("b"), "spans").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.b) for r in got) == sorted((i is None, i or 0, brute_base(t)) for i, t, _, _ in rows)
    owners, repos = {}, {}
    for i, text, lang, source in rows:
        base = secrets.base_spans(text or "")
        for *_, value in base + secrets.token_spans(text or "", base):
            owners.setdefault(value, set()).add(source)
            repos.setdefault(value, set()).add((source, lang))
    values = {t: secrets.base_spans(t or "") + secrets.token_spans(t or "", secrets.base_spans(t or "")) for _, t, _, _ in rows}
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        of = {(s, k): v for s, k, _, v in values[texts[r.doc_id]]}
        for s in r.spans:
            v = of[s.start, s.kind]
            assert (s.owners, s.repos, s.live) == (len(owners[v]), len(repos[v]), len(owners[v]) < 3 and len(repos[v]) < 12)


def test_a_value_in_many_repositories_of_one_owner_is_no_live_secret(spark):
    rows = [(i, "token=abcdefgh12345678", "one", f"repo{i}") for i in range(50)] + [(90, "token=zyxwvuts87654321", "one", "repo1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    live = {r.doc_id: r.n_live for r in secrets.find_secrets(df).collect()}
    assert live[0] == 0 and live[90] == 1


def test_a_rare_toxic_word_is_learnt_at_every_vocabulary_size(spark):
    rng = random.Random(4)
    for vocabulary in (100, 3000):
        background = lambda: [f"w{rng.randrange(vocabulary)}" for _ in range(40)]
        rows = [(" ".join([*background(), "vile"]), 1) for _ in range(12)] + [(" ".join(background()), int(i % 20 == 0)) for i in range(1500)]
        found = toxicity.learn_counts(spark.createDataFrame(rows, "text string, label int"))
        word = toxicity.WordHasher().of([b"vile"]).view("int64")[0]
        assert [r.times for r in found.filter(F.col("k") == F.lit(int(word))).collect()] == [12]


def test_counts_of_expressions_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(" ".join(rng.choice("abcde") for _ in range(rng.randrange(8))) if i % 9 else None, rng.randrange(2)) for i in range(80)]
    df = spark.createDataFrame(rows, "text string, label int").repartition(3)
    got = {}
    for r in df.mapInArrow(toxicity._count_bigrams, "u long, w long, c0 long, c1 long").collect():
        c = got.setdefault((r.u, r.w), [0, 0])
        c[0] += r.c0
        c[1] += r.c1
    hasher, want = toxicity.WordHasher(), {}
    for text, label in rows:
        words = [0, *hasher.of(alnum_words(text)).view("int64").tolist()]
        for pair in set(zip(words, words[1:])):
            want.setdefault(pair, [0, 0])[label] += 1
    assert got == want


def test_curve_holds_for_separated_classes_and_far_outliers():
    import numpy as np

    rng = np.random.RandomState(0)
    label = (rng.rand(5000) < 0.1).astype(float)
    n = rng.randint(1, 400, 5000).astype(float)
    llr = np.where(label == 1, rng.uniform(2, 30, 5000), np.where(rng.rand(5000) < 0.9, 0.0, rng.uniform(-5, 0.5, 5000)))
    for far in (6000.0, -900.0):
        llr[int(np.flatnonzero(label == (far > 0))[0])] = far
    beta = toxicity.fit_curve(n, llr, label)
    score = 1 / (1 + np.exp(-np.clip(toxicity.features(n, llr) @ beta, -30, 30)))
    assert (score[label == 1] >= 0.3).mean() > 0.99 and (score[label == 0] >= 0.3).mean() < 0.01
    assert np.abs(beta).max() < 1e4


def test_toxicity_head_leaves_ties_to_the_tail(spark, monkeypatch):
    values = spark.createDataFrame([(i, 5 if i < 10 else 9 + i, 1.0) for i in range(20)], "k long, times long, value double")
    monkeypatch.setattr(toxicity, "TABLE_BITS", 4)
    head, tail = toxicity._split(values)
    assert sorted(head["keys"].tolist()) == list(range(10, 20)) and tail.count() == 10


def test_unlike_texts_of_one_id_join_their_components(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (0, a + " tail"), (2, b + " tail"), (7, "else"), (None, a)]
    got = {}
    for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.component_id)
    assert got == {0: {0}, 1: {0}, 2: {0}, 7: {7}, None: {0}}


def test_line_dedup_with_clashing_and_dotted_names(spark):
    rows = [(i, "https://h.org/x", f"<p>menu</p><p>page {i}</p>", "kept", "old", 1, "dot") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, lines string, host string, n_dropped int, `a.b` string")
    out = lines.drop_site_lines(df, "html", lines.host_of(F.col("url")))
    assert out.columns == ["page_id", "url", "lines", "a.b", "host", "n_lines", "n_dropped", "clean"]
    assert {(r.lines, r["a.b"], r.host, r.n_dropped, r.clean) for r in out.collect()} == {("kept", "dot", "h.org", 1, f"page {i}") for i in range(6)}


def test_clashing_and_dotted_names_pass_through(spark):
    rows = [(i, f"some words here {i}", "s", 1.0, 2, "x") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score double, predicted int, `a.b` string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    carried = toxicity.toxicity_scores(df, labels, carry=df.columns)
    assert carried.columns == [*df.columns, "__toxicity"] and carried.count() == 8
    assert mixing.mix_documents(df).columns == df.columns
    bench = spark.createDataFrame([("i", "words here 3")], "item_id string, text string")
    cleaned = decontam.remove_contamination(df, bench)
    assert cleaned.columns == df.columns and {r.doc_id: r.text for r in cleaned.collect()}[3] == "some "


def test_pipeline_carries_any_column(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, " ".join(f"w{(i * 7 + k) % 500}" for k in range(40)), "en", f"s{i % 2}", 1, 0.5, "d") for i in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, `a.b` string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("i", "none of it")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [f.split()[0].strip("`") for f in schema.split(", ")], name
    assert docs.count() > 0


@pytest.mark.parametrize("missing", ["zstandard", "xxhash"])
def test_the_rest_works_without_the_packages_of_the_llm_folder(missing):
    import subprocess
    import sys

    code = (f"import sys; sys.modules['{missing}'] = None\n"
            "import __spark_entry__ as e; q = e.queries(); assert 'q4_top_users' in q and 'pipeline' not in q")
    subprocess.run([sys.executable, "-c", code], check=True, cwd="/".join(__file__.split("/")[:-3]))


def test_components_after_some_more_links(spark):
    from slidecast.llm.blocks import _united
    from slidecast.llm.graph import components

    first, more = [(1, 2), (2, 3), (10, 11), (20, 21)], [(3, 11), (11, 1), (30, 31), (30, 21)]
    comps = components(spark.createDataFrame(first, "a long, b long"))
    got = {tuple(r) for r in _united(comps, spark.createDataFrame(more, "a long, b long"), "united").collect()}
    assert got == {tuple(r) for r in components(spark.createDataFrame(first + more, "a long, b long")).collect()}
