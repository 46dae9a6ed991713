"""Toxicity by class-conditional Kneser-Ney models.

A bigram model per class (toxic, ordinary) over the words of labelled
documents. N are numbers of distinct documents, so that a long or repetitive document
is one voice, and so are the copies of one (equal texts). Discounted class counts of bigrams are smoothed by discounted
class counts of words, and these by continuation counts (in how many contexts
a word occurs) that both classes share:

    P_c(w|u) = (N_c(uw) - D_c(uw)) / N_c(u) + B(u) P_c(w)
    P_c(w)   = (N_c(w) - D_c(w)) / N_c      + B P(w)
    P(w)     = contexts of w / contexts of all words

B(u) and B are the discounted shares of both classes' counts together, so
falling back costs both classes the same. An expression that is rare, or whose classes
differ by no more than chance, is discounted in full, so it goes through the
counts that both classes share and speaks for neither; others are discounted
by ``DISCOUNT``. Chance is the likelihood-ratio statistic of the two counts,
with one bar (``CLEAR``, passed by chance by one expression in some ten million) at every input
size; bigrams are held against the split of their word. A
document's evidence is the mean over its distinct words
(each the mean over its contexts) of ``log P_toxic - log P_ordinary``; a logistic curve, fitted on labelled
documents that the counts have not seen, turns evidence and length into a
score from 0 to 1.

Counts are Spark tables over every labelled document of the counting part
(``crc32(id) mod 4`` of 0 or 1), of all words and of all bigrams of words (the
first word's context is 0). An expression needs ``LEAST`` documents to speak for a
class, at every input size, whatever the vocabulary. Where a bigram's own counts are discounted in full,
the context cancels and its evidence is that of its word, which is 0 where the
word's are too (all rare words). So a score needs the expressions that speak
for a class only. The ``2^TABLE_BITS`` most frequent of them are sent to executors
(16 MB at most); the others, if any, are joined with the (row, expression)
pairs that may be among them (a bitmap of fixed size drops most others) and
added up per row, so no expression is left out. Words and bigrams are named by
64-bit hashes. The
curve is fitted on at most ``FIT_ROWS`` documents of the part ``mod 4 = 3``, those with
the smallest hash of the id; ``mod 4 = 2`` is never used for learning.

Labels meet documents by a broadcast of (id, label) up to ``BROADCAST_LABELS``
labels (counted first), beyond that by a shuffle join.

Edge cases: a null or empty text has evidence 0 and length 0 and is scored by
the curve like others; a null id is in part 0 but has no label; labels that
repeat an id count once, toxic if any says so; without labels of both classes
the score is the share of toxic labels (0 without any); an empty table gives
an empty result; very long texts are counted and scored whole; rows that repeat
(id, text) are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import WordHasher, alnum_words, few_texts, materialize, mix, quoted, signed, slices

DISCOUNT = 0.75
TABLE_BITS = 20
TAIL_BITS = 23
LEAST = 5
CLEAR = 30.0
FIT_ROWS = 50_000
BROADCAST_LABELS = 2_000_000
THRESHOLD = 0.3
HELD_OUT, FIT_PART = 2, 3


def part(id_col: str):
    """crc32 of the id as text, mod 4 (0 for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4, F.lit(0)).cast("int")


def _pairs(words: list[bytes], hasher: WordHasher) -> np.ndarray:
    """Distinct (context, word) rows of a text; the first word's context is 0."""
    h = signed(hasher.of(words))
    return np.unique(np.stack([np.concatenate([h[:0] if not len(h) else [0], h[:-1]]).astype(np.int64), h], axis=1), axis=0)


def pair_names(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of each (context, word)."""
    return signed(mix(mix(u.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + w.view(np.uint64)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for hashes, classes in _token_blocks(batches, lambda words: np.unique(signed(hasher.of(words)))):
        distinct, first, c0, c1 = _class_counts(hashes, classes)
        for i in range(0, len(distinct), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[j]) for x in (distinct, c0, c1)], names=["w", "c0", "c1"])


def _count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for pairs, classes in _token_blocks(batches, lambda words: _pairs(words, hasher)):
        u, w = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
        _, first, c0, c1 = _class_counts(pair_names(u, w), classes)
        for i in range(0, len(first), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[j]) for x in (u[first], w[first], c0, c1)], names=["u", "w", "c0", "c1"])


def _token_blocks(batches, encode, block: int = 1 << 19):
    """Distinct codes of each text with its class, half a million at a time (texts whole)."""
    codes, classes, size = [], [], 0
    for batch in slices(batches):
        texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for text, label in zip(texts, labels, strict=True):
            c = encode(alnum_words(text))  # a document counts once
            if len(c):
                codes.append(c)
                classes.append(np.full(len(c), label, dtype=np.int8))
                size += len(c)
            if size >= block:
                yield np.concatenate(codes), np.concatenate(classes)
                codes, classes, size = [], [], 0
    if size:
        yield np.concatenate(codes), np.concatenate(classes)


def _class_counts(keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, a place of each, and how often each has class 0 and 1."""
    distinct, first, at = np.unique(keys, return_index=True, return_inverse=True)
    toxic = np.bincount(at, weights=classes == 1, minlength=len(distinct)).astype(np.int64)
    return distinct, first, np.bincount(at, minlength=len(distinct)).astype(np.int64) - toxic, toxic


def _discounted(counts: DataFrame, discount: float, share0: str, share1: str) -> DataFrame:
    """Adds k0 and k1, what each class keeps of its counts: nothing where they follow the shares up to chance."""
    term = "CASE WHEN {c} > 0 THEN {c} * ln({c} / greatest((c0 + c1) * ({s}), 1e-12)) ELSE 0 END"
    statistic = " + ".join(term.format(c=c, s=s) for c, s in (("c0", share0), ("c1", share1)))
    clear = f"c0 + c1 >= {LEAST} AND 2 * ({statistic}) > {CLEAR!r}D"
    return counts.withColumns({f"k{i}": F.expr(f"CASE WHEN {clear} THEN greatest(c{i} - {discount!r}D, 0D) ELSE 0D END") for i in range(2)})


def _ratio(p0: str, p1: str):
    return F.expr(f"ln(greatest({p1}, 1e-12D)) - ln(greatest({p0}, 1e-12D))")


def _name_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, w = (np.asarray(batch.column(i).to_numpy(), dtype=np.int64) for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(pair_names(u, w)), batch.column(2), batch.column(3)], names=["k", "times", "value"])


def learn_counts(labelled: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """Expressions that speak for a class, from rows (text, label): k, times, value.

    The value of a word is its evidence, that of a bigram what it adds to its word's.
    """
    rows = labelled.select(F.col("text").cast("string"), F.col("label").cast("int"))
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    grams = materialize(total(rows.mapInArrow(_count_bigrams, "u long, w long, c0 long, c1 long"), "u", "w"), "toxicity-bigrams")
    contexts = grams.groupBy("w").agg(F.count(F.lit(1)).alias("t"))
    words = materialize(total(rows.mapInArrow(_count_words, "w long, c0 long, c1 long"), "w").join(contexts, "w"), "toxicity-words")
    n0, n1, t = (x or 0 for x in words.agg(F.sum("c0"), F.sum("c1"), F.sum("t")).first())
    if not n0 or not n1:
        return words.filter("false").select(F.col("w").alias("k"), F.col("c0").alias("times"), F.lit(0.0).alias("value"))
    kept = _discounted(words, discount, f"{n0 / (n0 + n1)!r}D", f"{n1 / (n0 + n1)!r}D")
    back = 1 - (kept.agg(F.sum(F.expr("k0 + k1"))).first()[0] or 0.0) / (n0 + n1)
    kept = kept.withColumns({f"p{i}": F.expr(f"k{i} / {n} + {back!r}D * t / {t}") for i, n in enumerate((n0, n1))}).withColumn(
        "value", _ratio("p0", "p1"))

    # A bigram has counts of its own only where its classes split otherwise than those of its word do.
    often = grams.filter(f"c0 + c1 >= {LEAST}")
    of = kept.filter(f"c0 + c1 >= {LEAST}").select(
        "w", F.expr("(c0 + 0.5D) / (c0 + c1 + 1)").alias("s0"), F.expr("(c1 + 0.5D) / (c0 + c1 + 1)").alias("s1"), "p0", "p1", "value")
    own = materialize(_discounted(often.join(of, "w"), discount, "s0", "s1").filter("k0 + k1 > 0"), "toxicity-own")
    given = total(grams, "u").withColumnsRenamed({"c0": "n0", "c1": "n1"}).join(
        own.groupBy("u").agg(F.sum(F.expr("k0 + k1")).alias("k")), "u").select("u", "n0", "n1", F.expr("1 - k / (n0 + n1)").alias("back"))
    p = [f"k{i} / greatest(n{i}, 1) + back * p{i}" for i in range(2)]
    bigrams = own.join(given, "u").select("u", "w", F.expr("c0 + c1").alias("times"), (_ratio(*p) - F.col("value")).alias("value"))
    return materialize(kept.filter("k0 + k1 > 0").select(F.col("w").alias("k"), F.expr("c0 + c1").alias("times"), "value").union(
        bigrams.mapInArrow(_name_pairs, "k long, times long, value double")), "toxicity-values")


def _one_of_each(taught: DataFrame, few: bool) -> DataFrame:
    """Of rows with equal texts those with the smallest id, so a copied document is one voice.

    Ids and hashes meet first, without the texts; ``few`` says that they may be broadcast as the labels are.
    """
    named = taught.withColumn("__copy", F.xxhash64("__text"))
    first = materialize(named.groupBy("__copy").agg(F.min("__id").alias("__id")), "toxicity-distinct")
    return named.join(F.broadcast(first) if few else first, ["__copy", "__id"], "left_semi")


def _split(values: DataFrame) -> tuple[dict, DataFrame | None]:
    """The head that is sent to executors, and the table of the others (None if there are none)."""
    head, tail, slots = values, None, None
    if values.count() > 1 << TABLE_BITS:
        # The bar that leaves at most that many above it, from how many expressions have each count.
        room, bar = 1 << TABLE_BITS, 0
        for row in values.groupBy(F.least("times", F.lit(1 << 20)).alias("times")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("times")).toLocalIterator():
            if row.n > room:
                bar = row.times
                break
            room -= row.n
        head = values.filter(F.col("times") > bar)
    table = head.select("k", "value").toArrow()
    keys, value = (np.asarray(table.column(c).to_numpy()) for c in ("k", "value"))
    order = np.argsort(keys)
    if head is not values:
        sent = values.sparkSession.createDataFrame(pa.table({"k": pa.array(keys, pa.int64())}))
        tail = materialize(values.join(sent, "k", "left_anti").select("k", "value"), "toxicity-tail")
        slots = np.zeros(1 << TAIL_BITS, dtype=bool)
        found = tail.select(F.shiftrightunsigned("k", 64 - TAIL_BITS).alias("slot")).distinct().toArrow()
        slots[np.asarray(found.column("slot").to_numpy(), dtype=np.int64)] = True
    return {"keys": keys[order].astype(np.int64), "value": value[order].astype(np.float64), "slots": slots}, tail


def evidence(model: dict, hasher: WordHasher):
    """A function from words to (number of distinct words, their evidence by the head, names and weights for the tail)."""
    keys, value, slots = model["keys"], model["value"], model["slots"]

    def run(words: list[bytes]) -> tuple[int, float, np.ndarray, np.ndarray]:
        pairs = _pairs(words, hasher)
        u, w = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
        # Each distinct word speaks once: the mean over its contexts.
        own, place, times = np.unique(w, return_inverse=True, return_counts=True)
        names = np.concatenate([own, pair_names(u, w)])
        weights = np.concatenate([np.ones(len(own)), 1 / times[place]])
        known, llr = np.zeros(len(names), dtype=bool), 0.0
        if len(keys):
            at = np.minimum(np.searchsorted(keys, names), len(keys) - 1)
            known = keys[at] == names
            llr = float((weights[known] * value[at[known]]).sum())
        rest = np.zeros(len(names), dtype=bool)
        if slots is not None:
            rest = ~known & slots[(names.view(np.uint64) >> np.uint64(64 - TAIL_BITS)).astype(np.int64)]
        return len(own), llr, names[rest], weights[rest]

    return run


def _measure(model, text: str):
    """Adds n (distinct words), llr (their evidence by the head) and what the tail is asked for to rows with a column ``text``.

    The column comes back too, unless it is ``__text``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = evidence(model.value, WordHasher())
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = [judge(alnum_words(text)) for text in texts]
            keep = [i for i, name in enumerate(batch.schema.names) if name != "__text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep]
                + [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64()),
                   pa.array([x[2] for x in found], pa.list_(pa.int64())), pa.array([x[3] for x in found], pa.list_(pa.float64()))],
                names=[batch.schema.names[i] for i in keep] + ["__n", "__llr", "__names", "__weights"])
    return run


def _measured(rows: DataFrame, model, tail: DataFrame | None, text: str = "__text") -> DataFrame:
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    out = rows.mapInArrow(_measure(model, text), StructType(
        [*fields, StructField("__n", LongType()), StructField("__llr", DoubleType()),
         StructField("__names", ArrayType(LongType())), StructField("__weights", ArrayType(DoubleType()))]))
    if tail is None:
        return out.drop("__names", "__weights")
    out = materialize(out.withColumn("__row", F.monotonically_increasing_id()), "toxicity-measured")
    more = out.select("__row", F.explode(F.arrays_zip("__names", "__weights")).alias("x")).select(
        "__row", F.col("x.__names").alias("k"), F.col("x.__weights").alias("weight")).join(
        tail.hint("shuffle_hash"), "k").groupBy("__row").agg(F.sum(F.col("weight") * F.col("value")).alias("__more"))
    return out.drop("__names", "__weights").join(more, "__row", "left").withColumn(
        "__llr", F.col("__llr") + F.coalesce("__more", F.lit(0.0))).drop("__row", "__more")


def features(n: np.ndarray, llr: np.ndarray) -> np.ndarray:
    """Length-normalised evidence, plain and per root of length, with the length itself."""
    long = np.maximum(n, 1)
    mean = llr / long
    return np.stack([np.ones(len(n)), 10 * mean, llr / np.sqrt(long), np.log1p(n)], axis=1)


def fit_curve(n: np.ndarray, llr: np.ndarray, label: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps, each cut until the penalised likelihood grows.

    So classes that the evidence separates, or a text with a hundred times the evidence of others, cannot throw it off.
    """
    x = features(n, llr)
    beta = np.zeros(x.shape[1])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.logaddexp(0, z).sum() - label @ z + ridge / 2 * b @ b)

    now = loss(beta)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        gradient = x.T @ (label - p) - ridge * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        cut = 1.0
        while loss(beta + cut * step) > now - 1e-4 * cut * (gradient @ step) and cut > 1e-9:
            cut /= 2
        after = loss(beta + cut * step)
        if not after < now:
            break
        beta, gained, now = beta + cut * step, now - after, after
        if gained < 1e-9 * max(1.0, now):
            break
    return beta


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_id_col: str = "doc_id", label_col: str = "toxic", threshold: float = THRESHOLD,
                    carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_distinct words, evidence (mean per word).

    With ``carry`` (columns of ``docs``, whatever their names) these come back with a struct ``__toxicity``
    (held_out, score, predicted) instead.
    """
    spark = docs.sparkSession
    few_texts(spark)
    rows = docs.select(F.col(id_col).alias("__id"), part(id_col).alias("__part"), F.col(text_col).cast("string").alias("__text"))
    known = labels.select(F.col(label_id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).filter(
        "__id IS NOT NULL AND label IS NOT NULL").groupBy("__id").agg(F.max("label").alias("label"))
    labelled = known.count()
    if labelled <= BROADCAST_LABELS:
        known = F.broadcast(known)
    taught = rows.filter(F.col("__part") != HELD_OUT).join(known, "__id")
    model, tail = _split(learn_counts(_one_of_each(taught.filter(F.col("__part") != FIT_PART), labelled <= BROADCAST_LABELS).select(F.col("__text").alias("text"), "label")))
    sent = spark.sparkContext.broadcast(model)
    fit = taught.filter(F.col("__part") == FIT_PART)
    if labelled > FIT_ROWS:
        # A share of the ids by hash: FIT_ROWS of all labels are more than FIT_ROWS of one part.
        fit = fit.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < (FIT_ROWS << 20) // labelled)
    sample = _measured(fit.select("label", "__text"), sent, tail).select("__n", "__llr", "label").toArrow()
    n, llr, y = (np.asarray(sample.column(c).to_numpy(), dtype=np.float64) for c in ("__n", "__llr", "label"))
    share = float(y.mean()) if len(y) else 0.0
    if len(y) and 0 < share < 1:
        beta = fit_curve(n, llr, y)
    else:
        beta = np.array([math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0, 0.0])

    kept = [c.alias(f"__c{i}") for i, c in enumerate(quoted(carry))] if carry else [F.col(id_col).alias("doc_id")]
    # A text that is carried is sent to the tasks once, not beside a copy of itself.
    once = carry and text_col in carry and docs.schema[text_col].dataType == StringType()
    text = f"__c{carry.index(text_col)}" if once else "__text"
    measured = _measured(docs.select(
        *kept, part(id_col).alias("__part"), *([] if once else [F.col(text_col).cast("string").alias("__text")])), sent, tail, text)
    long = F.greatest(F.col("__n"), F.lit(1))
    z = (F.lit(float(beta[0])) + F.lit(float(beta[1])) * 10 * F.col("__llr") / long
         + F.lit(float(beta[2])) * F.col("__llr") / F.sqrt(long) + F.lit(float(beta[3])) * F.log1p("__n"))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    out = measured.withColumn("__score", score)
    judged = [(F.col("__part") == HELD_OUT).alias("held_out"), F.col("__score").alias("score"),
              (F.col("__score") >= threshold).cast("int").alias("predicted")]
    if carry:
        return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], F.struct(*judged).alias("__toxicity"))
    return out.select("doc_id", *judged, F.col("__n").alias("n_distinct"), (F.col("__llr") / long).alias("evidence"))
