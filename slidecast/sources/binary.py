"""Binary log values: the schema-less Avro form of a record of strings.

A string is its length in UTF-8 bytes as a zig-zag variable-length integer, then the bytes; a
record is its strings one after another (Apache Avro specification, "Binary encoding").
Both directions are column expressions: no per-record Python, no extra package. A value decodes only if every length
is there, is not negative and stays inside the value, and every string is valid
UTF-8; the others are dropped and counted. Bytes after the last string are ignored, as Avro
readers do. Strings may be up to 2^31 - 1 bytes, a null value never decodes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

_GROUPS = 5  # 7-bit groups of a length


def _let(name: str, value: str, body: str) -> str:
    """An expression that names a value, so it is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _length_bytes(n: str) -> str:
    """The zig-zag variable-length form of a length (lengths are not negative, so it is the double of n)."""
    groups = []
    for k in range(_GROUPS):
        low = f"shiftrightunsigned(2L * ({n}), {7 * k}) & 127"
        more = f"shiftrightunsigned(2L * ({n}), {7 * (k + 1)}) > 0"
        here = "true" if k == 0 else f"shiftrightunsigned(2L * ({n}), {7 * k}) > 0"
        groups.append(f"if({here}, unhex(lpad(hex(({low}) + if({more}, 128L, 0L)), 2, '0')), X'')")
    return f"concat({', '.join(groups)})"


def encode_strings(df: DataFrame, fields: Sequence[Column | str], key: Column | str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Records → ``key STRING, value BINARY``; a null string counts as empty."""
    names = [f"__f{i}" for i in range(len(fields))]
    key_col = F.lit(None).cast("string") if key is None else (F.col(key) if isinstance(key, str) else key).cast("string")
    bodies = df.select(key_col.alias("key"), *keep, *[
        F.coalesce((F.col(f) if isinstance(f, str) else f).cast("string"), F.lit("")).cast("binary").alias(n) for f, n in zip(fields, names, strict=True)])
    parts = [p for n in names for p in (F.expr(_length_bytes(f"cast(octet_length({n}) as bigint)")), F.col(n))]
    return bodies.select("key", F.concat(*parts).alias("value"), *keep)


def decode_strings(log: DataFrame, fields: Sequence[str], observation: Observation | str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``value BINARY`` → string columns; malformed values are dropped (counts as in :func:`.codec.decode`)."""
    octets = f"transform(sequence(0, {_GROUPS - 1}), k -> coalesce(cast(conv(hex(substring(value, a.at + k, 1)), 16, 10) as bigint), 255L))"
    groups = "cast(array_position(transform(b, y -> y < 128), true) as int)"  # 0: the length does not end
    length = ("CASE WHEN g = 0 THEN -1L ELSE " + _let(
        "w", "aggregate(sequence(0, g - 1), 0L, (t, k) -> t + shiftleft(b[k] & 127, 7 * k))", "if(w % 2 = 0, w div 2, -1L)") + " END")
    string = "cast(substring(value, a.at + g, cast(n as int)) as string)"
    step = (f"CASE WHEN a.ok AND n >= 0 AND a.at + g + n - 1 <= octet_length(value) AND is_valid_utf8({string}) THEN "
            f"named_struct('at', cast(a.at + g + n as int), 'ok', true, 'out', concat(a.out, array({string}))) "
            "ELSE named_struct('at', a.at, 'ok', false, 'out', a.out) END")
    step = _let("b", octets, _let("g", groups, _let("n", length, step)))
    start = "named_struct('at', 1, 'ok', value IS NOT NULL, 'out', cast(array() as array<string>))"
    df = log.select(*keep, F.expr(f"aggregate(sequence(1, {len(fields)}), {start}, (a, f) -> {step})").alias("__r"))
    if observation is not None:
        df = df.observe(observation, F.count(F.lit(1)).alias("events"), F.sum(F.when(F.col("__r.ok"), 0).otherwise(1)).alias("dropped"))
    # Exploded rather than filtered: a filter would be pushed down with a second copy of the decoder.
    kept = df.select(*keep, F.explode(F.expr("filter(array(__r), x -> coalesce(x.ok, false))")).alias("__x"))
    return kept.select(*keep, *[F.col("__x.out")[i].alias(name) for i, name in enumerate(fields)])
