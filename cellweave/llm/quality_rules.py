"""Quality rules with adaptive thresholds: quantile sketches per language and source instead of fixed cut-offs.

Counts of each text are taken in one pass. Four rates go into mergeable sketches: counts by logarithmic bin, exact
below 128 and within 1/64 above, so that sketches merge by adding (first per task, then per group) and come out the same
in any order. A group's quartiles give its limits, upper quartile + max(SPREAD * interquartile range, the rate's
margin), and the mirrored lower limit for word length. Groups under LEAST_ROWS rows use the merged sketch of their language,
and that failing, of everything. Limits, one row per group, are joined to the documents and filter them.

Defined results: null or wordless texts have no words and fail the base rules; null languages and sources are groups
of their own; repeated rows are counted and judged each; an empty table gives an empty result. Other columns are
carried along by ``filter_documents`` under any name.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_small, keep, memory, packed

SPACE, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: rate: (numerator, factor, denominator, margin over the upper quartile, margin under the lower one or None)
RATES = {
    "symbols": ("n_symbols", 1000, "word_chars", 40, None),
    "dup_lines": ("n_dup_lines", 1000, "(n_lines + 4)", 200, None),
    "repeats": ("n_repeat_words", 1000, "n_words", 200, None),
    "word_length": ("word_chars", 100, "n_words", 250, 200),
}
SPREAD, LEAST_ROWS = 3, 50
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def count_text(data: bytes | None) -> tuple[int, ...]:
    """COUNTS of one text in UTF-8."""
    data = data or b""
    words = data.split()
    solid = data.translate(None, SPACE)
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    repeated = 0
    if len(seen) < len(windows):
        covered = -1  # last word counted so far
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 2 - max(covered, i - 1)
                covered = i + 2
    return (len(words), len(solid.decode("utf-8", "replace")), len(solid) - len(solid.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines))


_FIELDS = pa.struct([(c, pa.int64()) for c in COUNTS])


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def text_counts(texts: pa.Array) -> pa.Array:
    memory("quality")
    rows = [count_text(t.as_py()) for t in texts.cast(pa.large_binary())]
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] or [pa.array([], pa.int64())] * len(COUNTS), fields=list(_FIELDS))


def _bin(v: Column) -> Column:
    """The lower edge of a value's bin."""
    drop = F.greatest(F.length(F.bin(v)) - 7, F.lit(0)).cast("int")
    return F.when(v < 128, v).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop))


def _rates(c) -> dict[str, Column]:
    return {r: F.coalesce(F.expr(f"({num} * {factor}) div nullif({den}, 0)"), F.lit(0)) for r, (num, factor, den, *_) in RATES.items()}


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, rate, bin, n: sketches of each group, of each language (level 1) and of all (level 2); they merge by summing n."""
    rows = counted.where(~_base_failed()).select("lang", "source", F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), _bin(v).alias("bin")) for r, v in _rates(counted).items()])).alias("x"))
    fine = keep(rows.groupBy("lang", "source", "x.rate", "x.bin").agg(F.count("*").alias("n")), "rule-sketches")
    own = fine.select(F.lit(0).alias("level"), "lang", "source", "rate", "bin", "n")
    by_lang = fine.groupBy("lang", "rate", "bin").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "rate", "bin", "n")
    whole = by_lang.groupBy("rate", "bin").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "rate", "bin", "n")
    return own.unionByName(by_lang).unionByName(whole)


def limits(counted: DataFrame) -> DataFrame:
    """A row per (lang, source): hi_<rate> for each rate, lo_<rate> where a rate has a lower margin; null where nothing is known."""
    group = ["level", "lang", "source", "rate"]
    so_far = Window.partitionBy(*group).orderBy("bin")
    ranked = sketches(counted).withColumn("upto", F.sum("n").over(so_far)).withColumn("rows", F.sum("n").over(Window.partitionBy(*group)))
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("rows"), F.col("bin")))
    q = ranked.groupBy(*group).agg(F.max("rows").alias("rows"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    margin = F.create_map(*[F.lit(x) for r, v in RATES.items() for x in (r, v[3])])[F.col("rate")]
    under = F.create_map(*[F.lit(x) for r, v in RATES.items() for x in (r, v[4] if v[4] is not None else -1)])[F.col("rate")]
    spread = SPREAD * (F.col("q3") - F.col("q1"))
    edge = q.withColumn("hi", F.col("q3") + F.greatest(spread, margin)).withColumn("lo", F.when(under >= 0, F.col("q1") - F.greatest(spread, under)))
    wide = edge.groupBy("level", "lang", "source").agg(F.max("rows").alias("rows"), *[F.max(F.when(F.col("rate") == r, F.col(e))).alias(f"{e}_{r}") for r, v in RATES.items() for e in (("hi",) if v[4] is None else ("hi", "lo"))])
    wide = keep(wide, "rule-limits")
    names = [c for c in wide.columns if c[:3] in ("hi_", "lo_")]
    at = lambda level: wide.where((F.col("level") == level) & ((F.col("rows") >= LEAST_ROWS) | (level == 2)))
    out = keep(counted.select("lang", "source").distinct(), "rule-groups")
    for level, keys in ((0, ["lang", "source"]), (1, ["lang"])):
        found = keep(at(level).select(*keys, F.struct(*names).alias(f"level{level}")), "rule-level")
        out = join_small(out, found, keys)
    whole = F.broadcast(at(2).agg(F.first(F.struct(*names)).alias("level2")))  # one row
    out = out.join(whole).select("lang", "source", F.coalesce("level0", "level1", "level2").alias("x"))
    return keep(out.select("lang", "source", "x.*"), "rule-limits")


def verdict(columns: list[str]) -> Column:
    """False where a base rule or one of the limits is broken."""
    good = ~_base_failed()
    for r, v in _rates(None).items():
        good &= F.coalesce(v <= F.col(f"hi_{r}"), F.lit(True))
        if f"lo_{r}" in columns:
            good &= F.coalesce(v >= F.col(f"lo_{r}"), F.lit(True))
    return good


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept for every row of documents (doc_id, text, lang, source)."""
    counted = keep(docs.select("doc_id", "lang", "source", text_counts("text").alias("x")).select("doc_id", "lang", "source", "x.*"), "rule-counts")
    joined = join_small(counted, limits(counted), ["lang", "source"])
    return joined.select("doc_id", *COUNTS[:5], _base_failed().alias("base_failed"), verdict(joined.columns).alias("kept"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns."""
    counted = keep(docs.select("lang", "source", text_counts("text").alias("x")).select("lang", "source", "x.*"), "rule-counts")
    lim = limits(counted)
    bounds = lim.select("lang", "source", F.struct(*[c for c in lim.columns if c not in ("lang", "source")]).alias("limits"))
    own = packed(docs).select("packed", F.col("packed.lang").alias("lang"), F.col("packed.source").alias("source"), text_counts("packed.text").alias("counts"))
    joined = join_small(own, bounds, ["lang", "source"]).select("packed", "counts.*", "limits.*")
    return joined.where(verdict(joined.columns)).select("packed.*")


def _sql() -> str:
    rates = ", ".join(f"coalesce(({n} * {f}) // nullif({d}, 0), 0) AS {r}" for r, (n, f, d, *_) in RATES.items())
    names = [(e, r) for r, v in RATES.items() for e in (("hi",) if v[4] is None else ("hi", "lo"))]
    edge = ", ".join(f"max(CASE WHEN rate = '{r}' THEN " + (f"q3 + greatest({SPREAD} * (q3 - q1), {RATES[r][3]})" if e == "hi" else f"q1 - greatest({SPREAD} * (q3 - q1), {RATES[r][4]})") + f" END) AS {e}_{r}" for e, r in names)
    pick = lambda e, r: f"coalesce(a.{e}_{r}, b.{e}_{r}, z.{e}_{r})"
    tests = " AND ".join(f"coalesce(d.{r} {'<=' if e == 'hi' else '>='} {pick(e, r)}, true)" for e, r in names)
    unpivot = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {r} AS v FROM c WHERE NOT base_failed" for r in RATES)
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n
  FROM (SELECT rid, unnest(range(1, len(words) - 1)) AS i, unnest(list_zip(words[:-3], words[2:-2], words[3:])) AS t FROM w)
), rep AS (
  SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM win WHERE n > 1) GROUP BY rid
), lin AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid
), b AS (
  SELECT w.rid, doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN lin USING (rid) LEFT JOIN rep USING (rid)
), c AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {rates} FROM b
), u AS ({unpivot}
), v AS (
  SELECT lang, source, rate, CASE WHEN v < 128 THEN v ELSE (v >> (length(ltrim(bin(v), '0')) - 7)) << (length(ltrim(bin(v), '0')) - 7) END AS bin FROM u
), lv AS (
  SELECT 0 AS level, lang, source, rate, bin FROM v UNION ALL SELECT 1, lang, NULL, rate, bin FROM v UNION ALL SELECT 2, NULL, NULL, rate, bin FROM v
), q AS (
  SELECT level, lang, source, rate, count(*) AS n, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM lv GROUP BY ALL
), m AS (
  SELECT level, lang, source, max(n) AS n, {edge} FROM q GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {tests} AS kept
FROM c AS d LEFT JOIN m AS a ON a.level = 0 AND a.n >= {LEAST_ROWS} AND a.lang IS NOT DISTINCT FROM d.lang AND a.source IS NOT DISTINCT FROM d.source
LEFT JOIN m AS b ON b.level = 1 AND b.n >= {LEAST_ROWS} AND b.lang IS NOT DISTINCT FROM d.lang LEFT JOIN m AS z ON z.level = 2
"""


SQL = _sql()
