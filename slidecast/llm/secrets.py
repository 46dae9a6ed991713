"""Secret scan with corpus-wide ownership frequency.

Base spans come from three fixed patterns (see ``KINDS``), leftmost and
non-overlapping per kind, over whole texts; positions are code points. Beside
them, long tokens of mixed letters and digits are *candidates*.

Every span and candidate is hashed; hashes are counted over the whole corpus
by distinct owners and distinct repositories. A value that ``widely`` owners
or more have, or ``widely_repos`` repositories or more (one owner who copies a template into many), is
a copied example; one that few owners have in few repositories looks live. Base
spans always stay and carry their verdict; a candidate becomes a span of kind
``token`` only if it belongs to few owners and stands apart from base spans.

Counts are two-step aggregates (distinct owner and repository first), so an
example that a third of all texts holds is one row per owner and task. Scan
results are written once with a row number of their own, so rows that repeat
an id stay apart.

Edge cases: null text counts as empty; null owners and repositories are
values of their own; very long texts are scanned whole; spans that start together keep the order of
``KINDS``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Kinds in order, with their patterns and least lengths.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

WIDELY, WIDELY_REPOS = 3, 12
TOKEN_LENGTH = 20
_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(f"[0-9a-f]{{{HEX_LENGTH},}}")  # whole runs either way
_TOKEN = re.compile(f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{TOKEN_LENGTH},}}")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the fixed patterns."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def token_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens with digits and letters that touch no base span."""
    out = []
    for m in _TOKEN.finditer(text):
        value = m[0]
        digits = sum(c.isdigit() for c in value)
        if digits < 3 or len(value) - digits < 3 or len(set(value)) < 10:
            continue
        if all(m.end() <= s or m.start() >= e for s, _, e, _ in taken):
            out.append((m.start(), 3, m.end(), value))
    return out


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value_hash", pa.string())])
_SPAN_DDL = "array<struct<start:bigint,kind:int,end:bigint,value_hash:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(spans):
        return [{"start": s, "kind": k, "end": e, "value_hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32]}
                for s, k, e, v in spans]

    for batch in batches:
        base, tokens = [], []
        for text in batch.column(3).to_pylist():
            found = base_spans(text) if text else []
            base.append(rows(found))
            tokens.append(rows(token_spans(text, found)) if text else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(base, pa.list_(_SPAN)), pa.array(tokens, pa.list_(_SPAN))],
            names=["doc_id", "owner", "repo", "base", "tokens"])


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, owner, repo) rows to (value_hash, owners, repos), nulls counting as a value."""
    once = found.groupBy("value_hash", "owner", "repo").agg(F.count(F.lit(1)).alias("uses"))
    return once.groupBy("value_hash").agg(
        F.count_distinct(F.struct("owner")).alias("owners"), F.count_distinct(F.struct("owner", "repo")).alias("repos"),
        F.sum("uses").alias("uses"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_cols: tuple[str, ...] = ("source", "lang"), widely: int = WIDELY,
                 widely_repos: int = WIDELY_REPOS) -> DataFrame:
    """One row per document: doc_id, base and spans (structs in order, with owners, repos and live), counts by kind."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"),
        F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in repo_cols]).alias("repo"),
        F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    scanned = materialize(
        rows.mapInArrow(_scan, f"doc_id {id_type}, owner string, repo string, base {_SPAN_DDL}, tokens {_SPAN_DDL}")
        .withColumn("row", F.monotonically_increasing_id()), "secret-scan")
    each = scanned.filter(F.size("base") + F.size("tokens") > 0).select(
        "row", "owner", "repo", F.inline(F.concat("base", "tokens")))
    owned = ownership(each).withColumn("live", (F.col("owners") < widely) & (F.col("repos") < widely_repos))
    judged = each.join(owned, "value_hash").filter("kind < 3 OR live")
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "start", "kind", "end", "value_hash", "owners", "repos", "live"))).alias("spans"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    out = scanned.join(spans, "row", "left").withColumn("spans", F.coalesce("spans", empty))
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return out.select(
        "doc_id", *[number(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"), "base", "spans")


def spelled(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
