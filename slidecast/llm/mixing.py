"""Mixing sources to target weights by pivotal dependent rounding.

Native DataFrame code throughout. Sizes are words of the text. The sources,
by code point with null last, weigh 1, 2, 3, repeating; they share all words
by weight, no source gets more than ``MAX_COPIES`` times its own words, and
what that frees is shared again by weight (water filling, solved in closed
form over one row per source).

A document of a source with factor ``f = target / source size`` is taken
``floor(f)`` times plus a fractional copy of probability ``p = f - floor(f)``.
Pivotal rounding settles the fractions: two fractional documents trade mass
in words (``p_i * size_i + p_j * size_j`` stays the same, each ``p`` keeps its
expectation) until one of them is 0 or 1. Documents are paired inside blocks
of bounded size; the one document that stays fractional in a block goes up a
reduction tree, level by level, until a source has a single one, which goes
to its nearer end. A source's taken words thus miss its target by half a
document at most. Blocks are formed by position (a hash bucket with its own row
numbers), so a source with a third of all rows is many blocks and a tree of
log rounds. Draws come from a hash of the document and the seed: reruns agree.

Edge cases: null and empty texts have size 0 and are taken 0 words (their
copies follow the same law); a source without words has target 0; all null
sources are one source; repeated rows count one by one; an empty table gives
an empty result. Columns of the input with clashing names are passed through
untouched only by :func:`mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITESPACE_WORD, materialize, quoted

MAX_COPIES = 3
BLOCK = 128
SEED = 20240229
_ROWS_PER_BUCKET = 4096


def source_targets(sizes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) rows to (source, source_size, target).

    With caps ``c = max_copies * size`` and weights ``w`` in order of ``c / w``,
    the water level after the first k caps are full is
    ``(total - caps so far) / weights left``; a source is full exactly if
    ``c / w`` is not above the level that its own place in the order gives.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn(
        "w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")
    ).withColumn("cap", F.col("source_size").cast("double") * max_copies)
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = (
        weighed.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("w_left"))
        .withColumn("full", F.col("cap") / F.col("w") <= F.col("level"))
        # Once a place in the order is not full, no later one is and levels only fall: the first of them is the largest.
        .withColumn("water", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    )
    return filled.select(
        "source", "source_size",
        F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("water"))).alias("target"))


def _uniform(*parts, seed: int, salt: int):
    """A number in [0, 1) from a hash of the parts."""
    h = F.xxhash64(*parts, F.lit(seed), F.lit(salt))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


# The fold over a block. State: the fractional document in hand (or none) and those settled so far.
# Mass moves between the one in hand (a) and the next (b): with probability d2/(d1+d2), d1 words go from b to a,
# else d2 from a to b, where d1 and d2 are the most that can move before one of them is 0 or 1.
_FOLD = """
aggregate(
  units,
  cast(named_struct('hand', null, 'settled', array()) as struct<hand:{unit},settled:array<{out}>>),
  (s, b) -> CASE
    WHEN s.hand IS NULL THEN named_struct('hand', b, 'settled', s.settled)
    ELSE element_at(transform(
      array(named_struct('a', s.hand, 'b', b,
        'd1', least((1 - s.hand.p) * s.hand.size, b.p * b.size),
        'd2', least(s.hand.p * s.hand.size, (1 - b.p) * b.size))),
      t -> element_at(transform(
        array(CASE
          WHEN t.b.u * (t.d1 + t.d2) < t.d2 THEN named_struct(
            'pa', if(t.d1 >= (1 - t.a.p) * t.a.size, 1D, t.a.p + t.d1 / t.a.size),
            'pb', if(t.d1 >= t.b.p * t.b.size, 0D, t.b.p - t.d1 / t.b.size))
          ELSE named_struct(
            'pa', if(t.d2 >= t.a.p * t.a.size, 0D, t.a.p - t.d2 / t.a.size),
            'pb', if(t.d2 >= (1 - t.b.p) * t.b.size, 1D, t.b.p + t.d2 / t.b.size)) END),
        q -> CASE
          WHEN q.pa > 0 AND q.pa < 1 THEN named_struct(
            'hand', cast(named_struct('uid', t.a.uid, 'size', t.a.size, 'p', q.pa, 'u', t.a.u) as {unit}),
            'settled', concat(s.settled, array(named_struct('uid', t.b.uid, 'extra', cast(round(q.pb) as int)))))
          WHEN q.pb > 0 AND q.pb < 1 THEN named_struct(
            'hand', cast(named_struct('uid', t.b.uid, 'size', t.b.size, 'p', q.pb, 'u', t.b.u) as {unit}),
            'settled', concat(s.settled, array(named_struct('uid', t.a.uid, 'extra', cast(round(q.pa) as int)))))
          ELSE named_struct(
            'hand', cast(null as {unit}),
            'settled', concat(s.settled, array(
              named_struct('uid', t.a.uid, 'extra', cast(round(q.pa) as int)),
              named_struct('uid', t.b.uid, 'extra', cast(round(q.pb) as int)))))
        END), 1)), 1)
  END)
"""


def _most(units: DataFrame) -> int:
    """Rows of the largest group."""
    return units.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def pivotal_round(units: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Settle fractions: rows (grp, uid, size > 0, 0 < p < 1) to rows (grp, uid, extra 0 or 1).

    ``uid`` is a struct or scalar that tells the rows of a group apart. Each
    level numbers the rows of hash buckets, folds blocks of ``block``
    consecutive numbers and hands one fractional row per block to the next.
    """
    uid = units.schema["uid"].dataType.simpleString()
    unit = f"struct<uid:{uid},size:double,p:double,u:double>"
    fold = F.expr(_FOLD.format(unit=unit, out=f"struct<uid:{uid},extra:int>"))
    settled: list[DataFrame] = []
    level, most = 0, _most(units)
    while most > 1:
        buckets = -(-most // _ROWS_PER_BUCKET)
        numbered = units.withColumn("u", _uniform("uid", seed=seed, salt=level)).withColumn(
            "bucket", F.pmod(F.xxhash64("uid", F.lit(seed), F.lit(~level)), F.lit(buckets)))
        folded = materialize(
            numbered.withColumn("pos", F.expr(f"(row_number() over (partition by grp, bucket order by u, uid) - 1) div {block}"))
            .groupBy("grp", "bucket", "pos")
            # Large documents first: the small ones that follow take up their remainders.
            .agg(F.expr("sort_array(collect_list(named_struct('size', -size, 'uid', uid, 'p', p, 'u', u)))").alias("units"))
            .select("grp", F.expr(f"transform(units, x -> cast(named_struct('uid', x.uid, 'size', -x.size, 'p', x.p, 'u', x.u) as {unit}))").alias("units"))
            .select("grp", fold.alias("s")), f"pivotal-{level}")
        settled.append(folded.select("grp", F.inline("s.settled")))
        units = folded.filter("s.hand IS NOT NULL").select("grp", "s.hand.uid", "s.hand.size", "s.hand.p")
        most, level = _most(units), level + 1
    # At most one row of a group is left: to the nearer end, so that the group misses by half a row at most.
    result = units.select("grp", "uid", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("extra"))
    for part in settled:
        result = result.unionByName(part)
    return result


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, text_hash, nth, size, source, source_size, target, copies.

    ``(doc_id, text_hash, nth)`` tells rows apart, ``nth`` numbering equal ones.
    """
    rows = materialize(docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WHITESPACE_WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), max_copies)
    targets = materialize(targets.withColumn(
        "factor", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))),
        "mix-targets").withColumnRenamed("source", "t_source")
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source").withColumn(
        "nth", F.row_number().over(Window.partitionBy("doc_id", "text_hash", "source").orderBy("size")))
    rows = rows.withColumn("whole", F.floor("factor").cast("int")).withColumn("p", F.col("factor") - F.col("whole"))
    key = F.struct("doc_id", "text_hash", "nth")
    extra = pivotal_round(
        rows.filter("size > 0 AND p > 0").select(
            F.col("source").alias("grp"), key.alias("uid"), F.col("size").cast("double").alias("size"), "p"), seed
    ).filter("extra = 1").select(
        F.col("grp").alias("x_source"), F.col("uid.doc_id").alias("x_id"), F.col("uid.text_hash").alias("x_hash"),
        F.col("uid.nth").alias("x_nth"), "extra")
    return rows.join(
        extra,
        F.col("doc_id").eqNullSafe(F.col("x_id")) & (F.col("text_hash") == F.col("x_hash"))
        & (F.col("nth") == F.col("x_nth")) & F.col("source").eqNullSafe(F.col("x_source")), "left",
    ).select("doc_id", "text_hash", "nth", "size", "source", "source_size", "target",
             (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int").alias("copies"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its copies say, with the columns of ``docs``."""
    names = docs.columns
    plan = mix_plan(docs, id_col, text_col, source_col, max_copies, seed).filter("copies > 0").select(
        F.col("doc_id").alias("__mix_id"), F.col("text_hash").alias("__mix_hash"), F.col("nth").alias("__mix_nth"),
        F.col("source").alias("__mix_source"), F.col("copies").alias("__mix_copies"))
    rows = docs.withColumn("__hash", F.xxhash64(text_col)).withColumn(
        "__size", F.length(text_col))
    # Equal (id, text, source) rows may differ in other columns only; any fixed order of them will do.
    rows = rows.withColumn("__nth", F.row_number().over(
        Window.partitionBy(id_col, "__hash", source_col).orderBy("__size")))
    return rows.join(
        plan,
        F.col(id_col).eqNullSafe(F.col("__mix_id")) & (F.col("__hash") == F.col("__mix_hash"))
        & (F.col("__nth") == F.col("__mix_nth")) & F.col(source_col).eqNullSafe(F.col("__mix_source")),
    ).withColumn("__copy", F.explode(F.expr("sequence(1, __mix_copies)"))).select(*quoted(names))
