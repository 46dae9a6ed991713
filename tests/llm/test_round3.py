"""Personal data, periodic runs and whitening: brute force, edge cases, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from slidecast.llm import periodic, pii, queries, whitening

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text)
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


TOKENS = ["1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "a@b.c", "a@b.c_d@e.f", "x@y", "@", "+1", "+12 (345) 678-9", "+1 2",
          "4111 1111 1111 1111", "4111-1111-1111-1111", "00000000000000", " ", "  ", "-", ".", "é", "(555) 123-4567",
          "me (at) you (dot) com", "10[.]0[.]0[.]1", "9" * 25, "call ", "order 4111111111111111", "\n", "0001.02.3.255", "\U0001F600"]


@pytest.fixture(scope="module")
def personal(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(TOKENS) for _ in range(rng.randrange(12)))) for i in range(400)]
    rows += [(None, None), (None, "a@b.c"), (5, ""), (5, "1 " * 3000 + "1" * 30_000 + "1.2.3.4 " * 1500 + "a.b" * 9000), (7, rows[7][1])]
    # Cards in longer chains of numbers: no base span, but a proposal like many that are.
    rows += [(1000 + i, f"pay with card 411111111111111{d} 12345 today" if i % 2 else f"my card 411111111111111{1} now")
             for i, d in enumerate([1] * 20)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, base string, `e0.s` int").repartition(3)
    return rows, pii.personal_data(df).select("doc_id", pii.spelled("base").alias("base"), pii.spelled("spans").alias("spans")).collect()


def test_base_spans_equal_brute_force(personal):
    rows, got = personal
    want = sorted((i is None, i or 0, ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(t))) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.base) for r in got) == want
    assert all(set(filter(None, r.base.split(","))) <= set(r.spans.split(",")) for r in got)


def test_trees_add_cards_inside_chains_and_refuse_failing_ones(personal):
    rows, got = personal
    spans = {r.doc_id: r.spans for r in got}
    assert all(spans[1000 + i] == "card:14:30" for i in range(1, 20, 2))


def test_no_model_without_two_labels(spark):
    df = spark.createDataFrame([(1, "x@y.org"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, len(r.spans)) for r in pii.personal_data(df).collect()) == [(1, 1), (2, 0)]
    assert pii.personal_data(df.filter("false")).count() == 0


def test_redact(spark):
    df = spark.createDataFrame([(1, "é x@y.org, 1.2.3.4!"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redact(df).collect()} == {1: "é [email], [ip]!", 2: ""}


def word_lists(rng, n):
    for _ in range(n):
        size = rng.choice([0, 1, 5, 11, 12, 13, 30, 60, 120])
        kind = rng.randrange(3)
        if kind == 0:
            yield [rng.choice("abc"[: rng.choice([2, 3])]) for _ in range(size)]
        elif kind == 1:
            u = [rng.choice("abcd") for _ in range(rng.randrange(1, 20))]
            w = (u * 120)[:size]
            if w and rng.random() < 0.5:
                w[rng.randrange(len(w))] = "z"
            yield w
        else:
            u, v = ([rng.choice("ab") for _ in range(rng.randrange(1, 6))] for _ in range(2))
            w = []
            while len(w) < size:
                w += u * rng.randrange(1, 6) + v
            yield w[:size]


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(150):
        docs = list(word_lists(rng, 4))
        assert periodic.periodic_runs(docs) == [periodic.brute_runs(d) for d in docs]
        least = rng.choice([2, 3, 20])
        assert periodic.periodic_runs(docs, least) == [periodic.brute_runs(d, least) for d in docs]


def test_pairs_stay_linear_for_one_repeated_word():
    words, _ = periodic.word_names([["x"] * 20_000])
    gram = periodic.Names(words).grams(4097)
    place, _ = periodic._occurrence_pairs(gram, 4096, 8192, 16383)
    assert len(place) < 20_000 and periodic.periodic_runs([["x"] * 20_000]) == [[(0, 20_000, 1)]]


def brute_op12(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = periodic.brute_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else (None,) * 3
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, periodic.spelled_digest(runs),
            hashlib.sha256(kept.encode()).hexdigest())


def test_op12_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(w) for w in word_lists(rng, 200)] + [" ".join(f"w{rng.randrange(400)}" for _ in range(300)) for _ in range(40)]
    rows = list(enumerate(texts)) + [(None, None), (None, texts[3]), (900, ""), (901, " \n"), (902, "é é " * 40), (5, texts[5]), (5, "y " * 3000)]
    spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, n int, runs string").repartition(3).write.parquet(
        str(tmp_path / "documents.parquet"))
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr(brute_op12(*r)) for r in rows)
    assert periodic.collapse_periods(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def reference_whitening(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    cov = np.cov(x.T.astype(float), bias=True).reshape(x.shape[1], -1)
    value, vec = np.linalg.eigh(cov)
    return ((n * x - s) ** 2).sum(axis=1), value[::-1][:k], vec[:, ::-1][:, :k], (x - s / n), np.trace(cov)


@pytest.mark.parametrize("dim", [1, 3, 40])
def test_whitening_equals_numpy(spark, dim):
    r = np.random.RandomState(dim)
    data = (r.randn(300, dim) @ r.randn(dim, dim)).astype(np.float32)
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(data)] + [
        (900, None, 1), (901, [None] * dim, 1), (902, [float("nan")] * dim, 1), (903, [float("inf")] * dim, 1), (904, [1.0] * (dim + 1), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int").repartition(4)
    got = whitening.whitened(df).collect()
    far, value, vec, centred, trace = reference_whitening(data)
    assert len(got) == 300 * min(8, dim) and {r.n for r in got} == {300}
    for row in got:
        j = row.component - 1
        assert row.deviation == far[row.vec_id] and abs(row.explained - value[j] / trace) < 1e-10 and row.identity_error < 1e-9
        assert abs(abs(row.whitened) - abs(centred[row.vec_id] @ vec[:, j]) / np.sqrt(value[j])) < 1e-8


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0  # no direction
    tied = [(i, [float(i == 0), float(i == 1), float(i == 2), float(i == 3)]) for i in range(4)] * 5
    got = whitening.whitened(spark.createDataFrame(tied, schema)).collect()  # three equal eigenvalues and none
    assert {r.component for r in got} == {1, 2, 3} and got[0].identity_error < 1e-9 and len(got) == 60
    wide = [(i, [1e9 * (i % 7), 1.0 * i]) for i in range(50)] + [(None, [1e300, 0.0])]
    big = whitening.whitened(spark.createDataFrame(wide, schema)).collect()
    assert all(np.isfinite(r.whitened) for r in big) and big[0].deviation > 1 << 63


def test_axes_of_near_ties():
    r = np.random.RandomState(1)
    q = np.linalg.qr(r.randn(30, 30))[0]
    for values in (np.r_[[5.0] * 4, [3.0] * 3, np.ones(23)], np.r_[1 + 1e-13 * np.arange(30)], np.r_[[1e6], np.linspace(1, 2, 29)]):
        a = q @ np.diag(values) @ q.T
        a = (a + a.T) / 2
        found, axes = whitening.principal_axes(a, 8)
        assert np.allclose(found, np.sort(values)[::-1][:8], rtol=1e-10)
        assert np.abs(axes.T @ axes - np.eye(8)).max() < 1e-12 and np.abs(a @ axes - axes * found).max() < 1e-9 * values.max()
