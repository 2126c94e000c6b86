"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in SQL functions only.

Every document draws an exponential key -ln(u)/w, where u comes from a hash of its id and w is its quality weight.
A source whose target exceeds its size takes whole epochs first; the rest of the target is filled with documents in
the order of their keys up to a cut-off. The cut-off is found without sorting a source in one task: keys fall into
about sqrt(n) buckets of near-equal expected size, bucket sums locate the one bucket in which the budget ends, and only
that bucket's keys are sorted. Documents are then judged against their source's cut-off. Rows of equal id and text share a key:
they are sorted as one entry with a count, and where the cut-off falls among them, as many of them are taken as the budget allows,
numbered by partition first and then inside partitions.

Defined results: null text has size 0; a null source is a source of its own, ordered last; a null id hashes as the
text 'null'. Whole documents are taken, so a source misses its target by half a document at most, repeated rows or not; which
of equal rows are taken is arbitrary but fixed for an input as it is stored. An empty table gives an empty result. Other columns
are ignored by ``mix`` and carried along by ``mix_documents`` under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_small, keep, packed

#: Weights of sources by rank, repeating; share of all words to take; most epochs of a source.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
#: Quality weights lie in [LEAST, 1], which bounds how uneven key buckets can be.
LEAST = 0.25
SYMBOLS = "#*$%&|<>"


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(text: Column, size: Column) -> Column:
    """1 for plain prose, less for each symbol character a word, LEAST at least."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.greatest(F.lit(LEAST), 1 - symbols / (2.0 * F.greatest(size, F.lit(1)))), F.lit(LEAST))


def _keyed(rows: DataFrame, doc_id: str, source: str, text: str, seed: int) -> DataFrame:
    """doc_id, source, size, key and tie of rows, and the rows themselves, where they have a column ``packed``."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    carried = [c for c in rows.columns if c == "packed"]
    sized = rows.select(*carried, F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"), _size(F.col(text)).alias("size"))
    return sized.select(*carried, "doc_id", "source", "size", (-F.log(u) / _weight(F.col("text"), F.col("size"))).alias("key"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("tie"))


def _targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, of one row per source: water-filling in closed form over sources by cap per weight."""
    everything = Window.partitionBy()
    ranked = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    by_level = everything.orderBy("__level", F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("__rank") % len(WEIGHTS) + 1).cast("int"))
    return (
        sizes.withColumn("__rank", F.row_number().over(ranked) - 1)
        .withColumn("__weight", weight)
        .withColumn("__level", F.lit(float(EPOCHS)) * F.col("source_size") / F.col("__weight"))
        .withColumn("__capped", F.coalesce(F.sum("source_size").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(EPOCHS)))
        .withColumn("__open", F.sum("__weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__fill", (F.lit(SHARE) * F.sum("source_size").over(everything) - F.col("__capped")) / F.col("__open"))
        .withColumn("__at", F.min(F.when(F.col("__fill") <= F.col("__level"), F.struct("__level", "__fill"))).over(everything)["__fill"])
        .withColumn("target", F.coalesce(F.least(F.lit(float(EPOCHS)) * F.col("source_size"), F.col("__at") * F.col("__weight")), F.lit(float(EPOCHS)) * F.col("source_size")))
        .select("source", "source_size", "__n", "target")
    )


def _bucket() -> Column:
    return F.floor((1 - F.exp(-F.col("key") * LEAST)) * F.col("buckets"))


def plan(narrow: DataFrame) -> DataFrame:
    """A row per source: source_size, target, epochs, buckets, edge (the bucket of the cut-off) and cut, the last entry (key, tie, doc_id) that
    is taken, and how many of its rows; nothing is drawn where cut is null."""
    sources = keep(_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__n"))), "mix-sources")
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("buckets", F.ceil(F.sqrt("__n")))
    bucketed = join_small(narrow, sources.select("source", "rest", "buckets"), ["source"], "inner").withColumn("bucket", _bucket())
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        bucketed.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("sum"))
        .withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
        .where(F.col("before") <= F.col("rest"))
        .groupBy("source").agg(F.max(F.struct("bucket", "before")).alias("x"))
    )
    edges = keep(edges.select("source", F.col("x.bucket").alias("edge"), F.col("x.before").alias("before")), "mix-edges")
    inside = join_small(bucketed, edges, ["source"], "inner").where(F.col("bucket") == F.col("edge"))
    entries = inside.groupBy("source", "rest", "before", "key", "tie", "doc_id", "size").agg(F.count("*").alias("n"))
    sooner = Window.partitionBy("source").orderBy("key", "tie", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(sooner), F.lit(0))
    fits = lambda k: F.col("at") + k * F.col("size") + F.col("size") / 2.0 <= F.col("rest")  # of the k-th row, from 0
    about = F.greatest(F.least(F.floor((F.col("rest") - F.col("at")) / F.greatest(F.col("size"), F.lit(1)) + 0.5), F.col("n")), F.lit(0))
    taken = F.when(F.col("size") == 0, F.when(fits(F.lit(0)), F.col("n")).otherwise(0)).when((about < F.col("n")) & fits(about), about + 1).when((about > 0) & ~fits(about - 1), about - 1).otherwise(about)
    cuts = entries.withColumn("at", at).withColumn("taken", taken).where("taken > 0").groupBy("source").agg(F.max(F.struct("key", F.struct("tie", "doc_id").alias("tie"), "taken", "n")).alias("cut"))
    return keep(join_small(join_small(sources.drop("__n", "rest"), edges.drop("before"), ["source"]), keep(cuts, "mix-cuts"), ["source"]), "mix-plan")


def _taken(keyed: DataFrame, planned: DataFrame) -> DataFrame:
    """Adds source_size, target and copies. A bucket whose documents were all too large leaves only those before it."""
    entry = F.struct("key", F.struct("tie", "doc_id").alias("tie"))
    last = F.struct(F.col("cut.key").alias("key"), F.col("cut.tie").alias("tie"))
    rows = join_small(keyed, planned, ["source"], "inner").withColumn("bucket", _bucket())
    inside = (F.col("bucket") == F.col("edge")) & F.col("cut").isNotNull()
    shared = F.coalesce(inside & entry.eqNullSafe(last) & (F.col("cut.taken") < F.col("cut.n")), F.lit(False))
    drawn = F.coalesce((F.col("bucket") < F.col("edge")) | (inside & (entry <= last)), F.lit(False))
    whole = rows.where(~shared).withColumn("copies", F.col("epochs") + drawn.cast("long"))
    if planned.where("cut.taken < cut.n").isEmpty():
        return whole
    # equal rows at a cut-off: written, so that their numbers stay
    some = keep(rows.where(shared), "mix-shared").withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftrightunsigned("row", 33))
    parts = some.groupBy("source", "part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.col("before") + F.row_number().over(Window.partitionBy("source", "part").orderBy("row"))
    numbered = join_small(some, keep(parts.drop("count"), "mix-parts"), ["source", "part"]).withColumn("copies", F.col("epochs") + (number <= F.col("cut.taken")).cast("long"))
    return whole.unionByName(numbered.drop("row", "part", "before"))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of documents (doc_id, source, text)."""
    narrow = keep(_keyed(docs.select("doc_id", "source", "text"), "doc_id", "source", "text", seed), "mix-keys")
    return _taken(narrow, plan(narrow)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixed corpus itself: rows of docs, each as often as it is taken, with the columns of docs."""
    narrow = keep(_keyed(docs.select("doc_id", "source", "text"), "doc_id", "source", "text", seed), "mix-keys")
    taken = _taken(_keyed(packed(docs), "packed.doc_id", "packed.source", "packed.text", seed), plan(narrow)).where("copies > 0")
    return taken.select("packed", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("packed.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0) AS symbols, text IS NULL AS missing,
         md5(coalesce(text, '')) AS tie, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':7'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), k AS (
  SELECT *, -ln(u) / CASE WHEN missing THEN 0.25::DOUBLE ELSE greatest(0.25::DOUBLE, 1 - symbols / (2.0::DOUBLE * greatest(size, 1))) END AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source
), r AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS weight FROM s
), l AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS level FROM r
), f AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY level, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY level, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fill FROM l
), t AS (
  SELECT source, source_size, coalesce(least(2.0::DOUBLE * source_size, (SELECT arg_min(fill, level) FROM f WHERE fill <= level) * weight), 2.0::DOUBLE * source_size) AS target FROM f
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (epochs + CASE WHEN coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, tie, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE
                                   <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
"""
