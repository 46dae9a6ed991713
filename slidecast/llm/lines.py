"""Line deduplication by site-relative frequency.

Lines are grouped by host; a line that stands on more than ``ratio`` of a
host's pages (and on ``min_pages`` of them at least) is boilerplate and is
dropped from every page of the host. Pages are counted, not occurrences.

A host's boilerplate is bounded: at most (distinct lines of an average page)
/ ratio lines. It travels as one array per host, so pages are never exploded
and gathered again; counts are partial aggregates per (host, line), and a hot
host is split by the adaptive join.

:func:`html_lines` cuts raw HTML into lines (one pass of Arrow batches): scripts, styles and comments go,
tags of blocks and line breaks end a line, other tags go, blanks are
collapsed, empty lines go. Tables with plain text use :func:`text_lines`.

Edge cases: a null or empty page has no lines; a null URL or one without host
belongs to the host ''; rows that repeat a page id are pages of their own;
case counts; an empty table gives an empty result; other columns are passed
through by :func:`drop_site_lines`; one named like a column of the result gives way to it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .common import materialize, quoted

RATIO = 0.3
MIN_PAGES = 3
RESULTS = ("host", "n_lines", "n_dropped", "clean")


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user, port, path, query or fragment; '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1), F.lit("")))


_HIDDEN = re.compile(rb"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->")
_BREAK = re.compile(
    rb"(?i)</?(?:p|div|li|ul|ol|tr|td|th|table|h[1-6]|br|nav|article|section|header|footer|title|head|body|html|a|pre"
    rb"|blockquote|form|aside|main)\b[^>]*>")
_TAG = re.compile(rb"<[^>]*>")


def text_lines(text: bytes) -> list[str]:
    """Lines with blanks collapsed, without the empty ones."""
    lines = (b" ".join(x.split()) for x in text.split(b"\n"))
    return [x.decode("utf-8", "surrogatepass") for x in lines if x]


def html_lines(html: bytes) -> list[str]:
    """Visible lines of raw HTML."""
    return text_lines(_TAG.sub(b"", _BREAK.sub(b"\n", _HIDDEN.sub(b" ", html))))


def with_lines(rows: DataFrame, column: str, cut=html_lines) -> DataFrame:
    """``rows`` with the lines of a text column in its place, as column ``lines``."""
    keep = [c for c in rows.columns if c != column]

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            cells = batch.column(at).cast(pa.binary()).to_pylist()
            out = [cut(x) if x else [] for x in cells]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(out, pa.list_(pa.string()))],
                names=keep + ["lines"])

    return rows.mapInArrow(run, StructType(
        [rows.schema[c] for c in keep] + [StructField("lines", ArrayType(StringType()))]))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines) rows of pages to (host, boilerplate array, host_pages)."""
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    counts = (
        pages.select("host", F.explode(F.array_distinct("lines")).alias("line"))
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages))
    heavy = counts.join(totals, "host").filter(F.col("pages") > F.col("host_pages") * ratio)
    return heavy.groupBy("host").agg(F.collect_set("line").alias("boilerplate"))


def drop_site_lines(pages: DataFrame, text_col: str, host: Column, cut=html_lines, ratio: float = RATIO,
                    min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` without their text, but with host, n_lines, n_dropped and clean (the lines that stay, joined)."""
    names = [c for c in pages.columns if c != text_col and c not in RESULTS]
    inner = [f"__c{i}" for i in range(len(names))]
    narrow = pages.select(*[c.alias(i) for c, i in zip(quoted(names), inner, strict=True)], host.alias("host"), quoted([text_col])[0].alias("__text"))
    rows = materialize(with_lines(narrow, "__text", cut), "site-lines")
    # Written first, so the join deals out both sides by itself and the pages of a hot host can be split.
    bad = materialize(boilerplate(rows.select("host", "lines"), ratio, min_pages), "site-boilerplate")
    joined = rows.join(bad.hint("shuffle_hash"), "host", "left")
    kept = F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains(F.col("boilerplate"), x)))
    return joined.withColumn("__kept", kept).select(
        *[F.col(i).alias(c) for c, i in zip(names, inner, strict=True)], "host", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("__kept")).cast("long").alias("n_dropped"),
        F.array_join("__kept", "\n").alias("clean"))
