"""Personal data by candidate gradient boosting, on built-in functions only.

1. High-recall generators propose overlapping spans. Per kind one strict
   pattern (its leftmost non-overlapping matches are the *base* proposals) and
   loose ones: digit runs inside a longer chain of numbers, phone numbers
   that run into what follows or lack the plus sign, defanged addresses,
   spelled-out ``at`` and ``dot``.
2. Format and context features of a proposal (checksum, digit count, groups,
   neighbouring characters, words before it) are packed into one small
   integer, its *code*. There are at most 2^18 codes at every input size, so
   the whole corpus is summed up exactly by counts per (code, label, fold).
3. Gradient-boosted trees (``pyspark.ml``) are fitted to these weighted
   counts. Labels come from the base proposals: 1 if the kind's check holds
   and the proposal stands free, 0 if it fails the check, is part of a longer
   token, or follows a word that names another kind of number.
4. One document in four (crc32 of the id) is held out of the fit. Per kind
   the threshold is the lowest score at which the held-out proposals reach
   ``PRECISION``. Loose proposals whose code scores that much are redacted
   too. Base spans that pass their check always stay.

Positions count code points, ends are exclusive. They come from the lengths
of the pieces between matches, so no text is walked once per match.

Edge cases: a null text counts as empty; rows that repeat an id, and rows with
a null id, are rows of their own (null ids are never held out); very long texts are handled whole,
linear in their length; equal spans of a kind from two generators are one; an
empty table, or one whose base proposals have one label only, has no model
and no added spans; other columns are never read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# The kinds in their listed order and their strict patterns. Possessive
# repeats and the look-behinds leave the matches as they are and keep the search linear.
KINDS = ("email", "ip", "card", "phone")
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=(?:[0-9][\x20-]?){12}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": [r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT|@)[\])]\x20?[A-Za-z0-9-]{1,63}+"
              r"(?:\x20?[\[(](?:dot|DOT|\.)[\])]\x20?[A-Za-z0-9-]{1,63}+|\.[A-Za-z0-9-]{1,63}+){1,8}+"],
    "ip": [r"(?<![0-9.])[0-9]{1,3}(?:[\[(]\.[\])][0-9]{1,3}){3}(?![0-9])"],
    "card": [r"(?<![0-9])[0-9]{13,19}(?![0-9])", r"(?<![0-9])[0-9]{4}(?:[\x20.-][0-9]{4}){3}(?![0-9])"],
    "phone": [r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2}(?![0-9])",
              r"(?<!\+[0-9]\x20)\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"],
}
# A stretch of characters that any number is made of (no number has fewer than 7), and the marks of a spelled-out address.
NUMBERS = r"[0-9+(][0-9\x20().+\[\]-]{6,}+"
SPELLED = ("(at)", "[at]", "(AT)", "[AT]", "(@)", "[@]")
#: Bits of a code, from the lowest: feature and width.
FEATURES = (("kind", 2), ("checked", 1), ("digits", 3), ("groups", 2), ("before", 2), ("after", 2),
            ("named", 1), ("other", 1), ("lead", 2), ("plain", 1))
CONTEXT = 24
PRECISION = 0.95
TREES, DEPTH = 10, 3
# Words before a proposal that speak for it, or for another kind of number.
NAMED = "(?i)mail|contact|phone|call|tel|mobile|fax|card|visa|credit|debit|host|address|from"
OTHER = "(?i)version|release|order|invoice|ticket|serial|isbn|sha|hash|token|password|secret|key"
_BLOCK = 256

_OCTETS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:[^0-9]+|$)){4}$"
_DIGIT = "int(substring(x.d, -j, 1))"
_LUHN = (f"aggregate(sequence(1, length(x.d)), 0L, (t, j) -> t + CASE WHEN j % 2 = 1 THEN {_DIGIT} "
         f"ELSE (2 * {_DIGIT}) div 10 + (2 * {_DIGIT}) % 10 END) % 10 = 0")
# Whether a proposal x (text s, its digits d, neighbours before and after) passes its kind's check.
_CHECK = {
    "email": "x.s rlike '[A-Za-z]$'",
    "ip": f"x.s rlike r'{_OCTETS}'",
    "card": f"CASE WHEN length(x.d) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END",
    "phone": "length(x.d) BETWEEN 9 AND 15",
}


def _class(c: str) -> str:
    """Character class of a neighbour: 0 none or blank, 1 mark, 2 letter or underscore, 3 digit."""
    return (rf"CASE WHEN {c} = '' OR {c} rlike r'^\s' THEN 0 WHEN {c} rlike '^[0-9]' THEN 3 "
            rf"WHEN {c} rlike r'^[\p{{L}}_]' THEN 2 ELSE 1 END")


_BEFORE, _AFTER = _class("substring(x.before, -1)"), _class("x.after")


def _code(kind: str) -> str:
    """The packed features of a proposal x."""
    found = {
        "kind": str(KINDS.index(kind)),
        "checked": f"CASE WHEN {_CHECK[kind]} THEN 1 ELSE 0 END",
        "digits": "CASE WHEN length(x.d) < 9 THEN 0 WHEN length(x.d) < 13 THEN 1 WHEN length(x.d) < 16 THEN 2 "
                  "WHEN length(x.d) = 16 THEN 3 WHEN length(x.d) < 20 THEN 4 ELSE 5 END",
        "groups": f"least(3, size(split(x.s, '{'[.]' if kind == 'email' else '[^0-9]+'}')) - 1)",
        "before": _BEFORE,
        "after": _AFTER,
        "named": f"CASE WHEN x.before rlike '{NAMED}' THEN 1 ELSE 0 END",
        "other": f"CASE WHEN x.before rlike '{OTHER}' THEN 1 ELSE 0 END",
        "lead": "CASE WHEN x.s like '+%' THEN 1 WHEN x.s rlike '^[3-6]' THEN 2 WHEN x.s rlike '^[(]' THEN 3 ELSE 0 END",
        "plain": "CASE WHEN length(x.d) > 0 AND size(array_distinct(split(x.d, ''))) <= 3 THEN 1 ELSE 0 END",
    }
    parts, shift = [], 0
    for name, bits in FEATURES:
        parts.append(f"shiftleft({found[name]}, {shift})")
        shift += bits
    return " + ".join(parts)


def _matches(df: DataFrame, found: dict[str, tuple[str, str]]) -> DataFrame:
    """Per output column: the matches of a pattern in an array of strings (s, start, before, after).

    Matches come in the same form, with their digits ``d`` and their place in the whole text. Each step is a
    projection of its own, so nothing is searched twice.
    """
    def step(make) -> None:
        nonlocal df
        df = df.select("*", *[F.expr(make(out, *of)).alias(f"{out}__") for out, of in found.items()]).select(
            *[F.col(c) for c in df.columns if c not in found], *[F.col(f"{out}__").alias(out) for out in found])

    keep = "'x', y.x, 'm', y.m, 'q', y.q"
    step(lambda out, of, p: f"filter(transform({of}, x -> named_struct('x', x, 'm', regexp_extract_all(x.s, r'{p}', 0))), y -> size(y.m) > 0)")
    step(lambda out, of, p: f"transform({out}, y -> named_struct('x', y.x, 'm', y.m, 'q', split(y.x.s, r'{p}', -1)))")
    step(lambda out, of, p: f"transform({out}, y -> named_struct({keep}, 'l', transform(y.m, (z, i) -> length(y.q[i]) + length(z))))")
    # Running sums in blocks, so a text of very many matches costs no square of them.
    step(lambda out, of, p: (
        f"transform({out}, y -> named_struct({keep}, 'l', y.l, 'b', aggregate(sequence(0, int((size(y.l) - 1) div {_BLOCK})), array(0), (a, k) -> "
        f"concat(a, array(element_at(a, -1) + aggregate(slice(y.l, k * {_BLOCK} + 1, {_BLOCK}), 0, (t, v) -> t + v))))))"))
    step(lambda out, of, p: (
        f"transform({out}, y -> named_struct({keep}, 't', transform(y.l, (z, i) -> y.x.start + y.b[int(i div {_BLOCK})] + "
        f"aggregate(slice(y.l, int(i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK} + 1), 0, (t, v) -> t + v))))"))
    step(lambda out, of, p: (
        f"flatten(transform({out}, y -> transform(y.m, (z, i) -> named_struct('s', z, 'd', regexp_replace(z, '[^0-9]', ''), "
        f"'start', y.t[i] - length(z), 'end', y.t[i], 'before', substring(concat(if(i = 0, y.x.before, ''), y.q[i]), -{CONTEXT}), "
        f"'after', substring(concat(substring(y.q[i + 1], 1, 1), if(i + 1 = size(y.m), y.x.after, '')), 1, 1)))))"))
    return df


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base (kind, start, end), labelled (code, label), loose (kind, start, end, code)."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    patterns = [(k, STRICT[k], True) for k in KINDS] + [(k, p, False) for k in KINDS for p in LOOSE[k]]
    # What a pattern is searched in: texts with its mark, or the stretches of digits and number marks.
    whole = "array(named_struct('s', text, 'start', 0, 'before', '', 'after', ''))"
    marked = " OR ".join(f"contains(text, '{m}')" for m in SPELLED)
    df = base.select("doc_id", F.expr(whole).alias("texts"), F.expr(f"filter({whole}, x -> contains(text, '@'))").alias("mails"),
                     F.expr(f"filter({whole}, x -> {marked})").alias("spelled"))
    df = _matches(df, {"numbers": ("texts", NUMBERS)}).drop("texts")
    where = {("email", True): "mails", ("email", False): "spelled"}
    df = _matches(df, {f"e{g}": (where.get((k, strict), "numbers"), p) for g, (k, p, strict) in enumerate(patterns)})
    out = {"strict": [], "base": [], "labelled": [], "loose": []}
    for g, (kind, _, strict) in enumerate(patterns):
        number = KINDS.index(kind)
        place = f"'kind', {number}, 'start', x.start, 'end', x.end"
        if not strict:
            out["loose"].append(f"transform(e{g}, x -> named_struct({place}, 'code', {_code(kind)}))")
            continue
        holds = "true" if kind == "email" else _CHECK[kind]
        out["strict"].append(f"transform(e{g}, x -> named_struct({place}))")
        out["base"].append(f"transform(filter(e{g}, x -> {holds}), x -> named_struct({place}))")
        free = f"{_BEFORE} < 2 AND {_AFTER} < 2 AND NOT x.before rlike '{OTHER}'"
        out["labelled"].append(
            f"transform(e{g}, x -> named_struct('code', {_code(kind)}, 'label', CASE WHEN {_CHECK[kind]} AND {free} THEN 1 ELSE 0 END))")
    df = df.select("doc_id", *[F.expr(f"concat({', '.join(v)})").alias(k) for k, v in out.items()])
    # A loose proposal counts only where no strict one stands, and outside the base spans.
    return df.select("doc_id", "base", "labelled", F.expr(
        "array_distinct(filter(loose, x -> NOT exists(strict, y -> y.kind = x.kind AND y.start = x.start AND y.end = x.end) "
        "AND NOT exists(base, y -> y.start <= x.start AND x.end <= y.end)))").alias("loose"))


def _unpacked(code: str) -> list[Column]:
    out, shift = [], 0
    for name, bits in FEATURES:
        out.append(F.expr(f"cast(shiftright({code}, {shift}) & {(1 << bits) - 1} as double)").alias(name))
        shift += bits
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from the fit (a null id never is)."""
    return F.coalesce(F.expr(f"crc32(cast(cast({id_col} as string) as binary)) % 4 = 2"), F.lit(False))


def score_codes(found: DataFrame, precision: float = PRECISION) -> DataFrame:
    """Per code: kind, score, label counts of the held-out rows, and whether its kind's threshold takes it.

    The tables here have one row per code, of which there are at most 2^18; null where there is nothing to fit.
    """
    labelled = found.select(held_out().alias("held"), F.explode("labelled").alias("x")).groupBy("x.code", "x.label", "held").agg(
        F.count(F.lit(1)).cast("double").alias("rows"))
    loose = found.select(F.explode("loose").alias("x")).select("x.code").distinct()
    counts = materialize(labelled.unionByName(loose.select("code", F.lit(-1).alias("label"), F.lit(False).alias("held"), F.lit(0.0).alias("rows"))), "pii-codes")
    fit = counts.filter("NOT held AND label >= 0")
    if fit.select("label").distinct().count() < 2:
        return counts.select("code", F.lit(0).alias("kind"), F.lit(0.0).alias("score"), F.lit(0.0).alias("right"), F.lit(0.0).alias("wrong"),
                             F.lit(False).alias("taken")).filter("false")
    names = [n for n, _ in FEATURES]
    vectors = VectorAssembler(inputCols=names, outputCol="features")
    # One partition: the table is bounded by the number of codes, and trees fit in the same order every time.
    train = vectors.transform(fit.repartition(1).sortWithinPartitions("code", "label").select("label", "rows", *_unpacked("code")))
    model = GBTClassifier(labelCol="label", weightCol="rows", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, checkpointInterval=-1).fit(train)
    every = counts.groupBy("code").agg(
        F.coalesce(F.sum(F.expr("CASE WHEN held AND label = 1 THEN rows END")), F.lit(0.0)).alias("right"),
        F.coalesce(F.sum(F.expr("CASE WHEN held AND label = 0 THEN rows END")), F.lit(0.0)).alias("wrong"))
    scored = model.transform(vectors.transform(every.select("code", "right", "wrong", *_unpacked("code")))).select(
        "code", F.col("kind").cast("int").alias("kind"), F.round(vector_to_array("probability")[1], 9).alias("score"), "right", "wrong")
    # Calibration: down a kind's scores, how many held-out proposals at or above each are right.
    above = Window.partitionBy("kind").orderBy(F.desc("score"))
    sure = scored.withColumn("r", F.sum("right").over(above)).withColumn("w", F.sum("wrong").over(above)).filter(
        F.expr(f"r > 0 AND `right` > 0 AND r >= {precision} * (r + w)")).groupBy("kind").agg(F.min("score").alias("least"))
    return scored.join(F.broadcast(sure), "kind", "left").select(
        "code", "kind", "score", "right", "wrong", F.expr("coalesce(score >= least, false)").alias("taken"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans, arrays of (kind, start, end) by kind as listed, then start."""
    found = materialize(proposals(docs, id_col, text_col), "pii-proposals")
    codes = sorted(r.code for r in score_codes(found, precision).filter("taken").select("code").toLocalIterator())
    taken = F.expr("filter(loose, x -> false)") if not codes else F.filter("loose", lambda x: F.array_contains(F.lit(codes), x["code"]))
    plain = F.transform(taken, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.array_distinct(F.concat("base", plain))).alias("spans"))


def spelled(column: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({column}, x -> concat_ws(':', array({names})[x.kind], string(x.start), string(x.end))), ',')")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with every span replaced by its kind in brackets, of rows whose id is not null and not repeated."""
    found = personal_data(docs, id_col, text_col).filter("size(spans) > 0").select("doc_id", F.expr(
        "array_sort(transform(spans, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind)))").alias("cuts"))
    names = ", ".join(f"'{k}'" for k in KINDS)
    step = (f"named_struct('out', concat(a.out, CASE WHEN x.start >= a.upto THEN concat(substring(text, a.upto + 1, x.start - a.upto), '[', array({names})[x.kind], ']') "
            "ELSE '' END), 'upto', greatest(a.upto, x.end))")
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return base.join(found, "doc_id", "left").select("doc_id", F.expr(
        f"CASE WHEN cuts IS NULL THEN text ELSE aggregate(cuts, named_struct('out', '', 'upto', 0), (a, x) -> {step}, a -> concat(a.out, substring(text, a.upto + 1))) END").alias("text"))
