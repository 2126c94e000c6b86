"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints within BITS differing bits, cut into BITS // 2 + 1 = 3 segments, agree in one segment but for one bit at
most. Each distinct fingerprint is therefore indexed under 64 keys, each a segment with one bit struck out; fingerprints
that link share a key. Copies of one fingerprint count once, so a hot text costs one entry. Then

1. every member of a key is held against the key's smallest one, and each fingerprint links to some (TRIES) of those that are within
   BITS; components of these links are found. This costs the size of a group of near copies and not its square;
2. members of keys of more than CROWD do the same with a random member of the key;
3. pairs of a key's members in different components are verified, under the first key that they share. In a key of more than CROWD
   members, those in the key's most frequent component are only held against the others;
4. all links together give the components.

Joins emit near pairs only. Components come from contracting links: every
root takes its smallest neighbour, chains are shortened by pointer jumping, links are rewritten to roots, until none is left.
All tables stay distributed and are written between rounds; those of no more use are deleted.

Defined results: null, empty and wordless texts have fingerprint zero and are linked like any other; repeated rows link
to each other; a null doc_id takes part but names no component unless all of its ids are null; an empty table gives an
empty result. ``deduplicate`` keeps one row of each component, the one of smallest (doc_id, row hash), nulls last, with all columns under
any name. Its components also link texts whose sets of word shingles are alike (Jaccard): such sets share a shingle among the first
n - ceil(similarity n) + 1 of any common order, which are the keys of an index as above; pairs whose own 128-bit SimHashes differ in more
than FAR bits are passed over (sets of similarity 0.8 differ in 19.5, with a deviation of 4.1: some one in ten thousand of them is lost,
fewer of those more alike; sets that have nothing else in common differ in 64, with 5.7). Where 64 * PARITIES parities of the numbers of
shingles by hash differ more often than sets so alike can have shingles in one of both only, they are not alike, without error. Whole sets verify the others. The order puts shingles that are frequent in a sample
of one text in SAMPLE last, which changes the work and never the result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.components import components
from ..plans.durable import scratch, whole
from .common import give_back, keep, memory, quoted

SHINGLE, SEED, BITS = 4, 42, 4
#: Of ``deduplicate``: words of a shingle, and the least Jaccard similarity as a fraction.
WORDS, ALIKE = 5, (4, 5)
SAMPLE, SAMPLE_LEAST, HOT, FAR, TRIES, CROWD = 8, 3, 100_000, 36, 6, 256
#: Longs of a set's parities: beyond some 500 shingles they rule out little.
PARITIES = 3
#: (first bit, width) of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def fingerprint(data: bytes | None) -> int:
    """Unsigned fingerprint of a text in UTF-8; bytes.lower() changes A to Z only and bytes.split() cuts at the asked white space."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - SHINGLE + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[len(words) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, n, step):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[i : i + step], stops[i : i + step])]
        ones += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


@F.arrow_udf(T.LongType())
def simhash(texts: pa.Array) -> pa.Array:
    """Fingerprints as signed longs."""
    memory("simhash")
    found = np.array([fingerprint(t.as_py()) for t in texts.cast(pa.large_binary())], np.uint64)
    return pa.array(found.view(np.int64))


def _variants(fp: Column) -> Column:
    """The 64 keys: 8 bits for the struck bit, then its segment without that bit."""
    keys = []
    for first, width in SEGMENTS:
        part = F.shiftrightunsigned(fp, first).bitwiseAND((1 << width) - 1)
        for bit in range(width):
            low = part.bitwiseAND((1 << bit) - 1)
            high = F.shiftleft(F.shiftrightunsigned(part, bit + 1), bit)
            keys.append(low.bitwiseOR(high).bitwiseOR(F.lit((first + bit) << 22)).cast("int"))
    return F.array(*keys)


def _first_shared(x: Column, key: Column) -> Column:
    """Whether key is the first key shared by two fingerprints of XOR x that share key."""
    struck = F.shiftright(key, 22)
    wanted = F.lit(-1)
    for first, width in reversed(SEGMENTS):
        mask = ((1 << width) - 1) << first
        part = x.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        bit = F.when(part == 0, first).when(part < 0, 63).otherwise(F.bit_count(part - 1))  # the place of a single bit
        wanted = F.when(F.bit_count(part) <= 1, bit).otherwise(wanted)
    return struck == wanted


def _roots(items: DataFrame, entries: Callable[[DataFrame], DataFrame], near: Callable[[Column, Column, Column | None], Column], links: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """(item, root) for all items (item, root: what is known to belong together), by links between items that share a key.

    entries(items): (key, item, print, root) of items; near(x, y, key): whether two prints may link; links(pairs): the pairs (a, b) of items that do.
    """
    keys = keep(entries(items).groupBy("key").agg(F.min(F.struct("item", "print")).alias("least"), F.count("*").alias("n")).where("n > 1"), f"{name}-keys")
    up = lambda roots, c: roots.select(F.col("item").alias(c), F.col("root").alias(f"{c}_root"))
    e, k = whole(entries(items).drop("root")), keys.select(F.col("key").alias("of"), "least")
    met = e.join(k, (e.key == k.of) & (F.col("item") != F.col("least.item")) & near(F.col("print"), F.col("least.print"), None)).select(F.col("least.item").alias("a"), F.col("item").alias("b"))
    apart = keep(met.distinct(), f"{name}-met").join(up(items, "a"), "a").join(up(items, "b"), "b").where("a_root <> b_root")
    tried = apart.groupBy("b").agg(*[F.min_by("a", F.xxhash64("a_root", F.lit(n))).alias(f"t{n}") for n in range(TRIES)])
    stars = tried.select(F.explode(F.array_distinct(F.array(*[f"t{n}" for n in range(TRIES)]))).alias("a"), "b")
    first = _joined_roots(items, links(keep(stars, f"{name}-stars")), f"{name}-first")
    crowds = keep(keys.where(F.col("n") > CROWD).select("key"), f"{name}-crowds")
    crowded = not crowds.isEmpty()
    if crowded:
        crowd = keep(entries(items).drop("root").join(crowds, "key"), f"{name}-crowd")
        now = whole(crowd).join(first, "item")
        pivots = now.groupBy("key").agg(F.min_by(F.struct("item", "print", "root"), F.xxhash64("item")).alias("pivot")).withColumnRenamed("key", "of")
        met = now.join(pivots, (F.col("key") == F.col("of")) & (F.col("root") != F.col("pivot.root")) & near(F.col("print"), F.col("pivot.print"), None))
        tried = met.groupBy("item").agg(*[F.min_by("pivot.item", F.xxhash64("pivot.item", F.lit(n))).alias(f"t{n}") for n in range(TRIES)])
        stars = keep(tried.select(F.explode(F.array_distinct(F.array(*[f"t{n}" for n in range(TRIES)]))).alias("a"), F.col("item").alias("b")), f"{name}-tried")
        first = _joined_roots(first, links(stars), f"{name}-first")
    rooted = entries(first)
    side = lambda rows, c: rows.select("key", *[F.col(x).alias(f"{c}_{x}") for x in ("item", "print", "root")])
    near_pair = near(F.col("a_print"), F.col("b_print"), F.col("key"))
    thin = rooted.join(crowds, "key", "left_anti") if crowded else rooted
    a, b = side(thin, "a"), side(thin, "b").withColumnRenamed("key", "of")
    pairs = whole(a).join(b, (F.col("key") == F.col("of")) & (F.col("a_root") < F.col("b_root")) & near_pair).select(F.col("a_item").alias("a"), F.col("b_item").alias("b"))
    if crowded:
        many = keep(whole(crowd).join(first, "item"), f"{name}-crowded")
        main = many.groupBy("key").agg(F.mode("root", True).alias("main"))
        a, b = side(whole(many).join(main, "key").where("root <> main"), "a").join(main, "key"), side(many, "b").withColumnRenamed("key", "of")
        other = (F.col("a_root") != F.col("b_root")) & ((F.col("b_root") == F.col("main")) | (F.col("a_root") < F.col("b_root")))
        pairs = pairs.union(whole(a).join(b, (F.col("key") == F.col("of")) & other & near_pair).select(F.col("a_item").alias("a"), F.col("b_item").alias("b")))
    return _joined_roots(first, links(keep(pairs.distinct(), f"{name}-pairs")), f"{name}-second")


def _joined_roots(roots: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """roots (item, root) with those made one that links (a, b) between items join."""
    up = lambda c: roots.select(F.col("item").alias(c), F.col("root").alias(f"{c}_root"))
    tops = components(links.join(up("a"), "a").join(up("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    return keep(roots.join(tops.select(F.col("v").alias("root"), F.col("root").alias("top")), "root", "left").select("item", F.coalesce("top", "root").alias("root")), name)


def _apart(x: Column, y: Column, n: int, first: int = 0) -> Column:
    """Differing bits of two prints in n longs from the first."""
    out = F.bit_count(x[first].bitwiseXOR(y[first]))
    for k in range(first + 1, first + n):
        out += F.bit_count(x[k].bitwiseXOR(y[k]))
    return out


def fingerprint_roots(fps: DataFrame) -> DataFrame:
    """(fp, root) for all distinct fingerprints fps (fp)."""
    with scratch(fps.sparkSession) as lasting:
        items = keep(fps.select(F.col("fp").alias("item"), F.col("fp").alias("root")), "fingerprints")
        entries = lambda rows: rows.select(F.explode(_variants(F.col("item"))).alias("key"), "item", F.array("item").alias("print"), "root")
        near = lambda x, y, key: (_apart(x, y, 1) <= BITS) & (F.lit(True) if key is None else _first_shared(x[0].bitwiseXOR(y[0]), key))
        return lasting(_roots(items, entries, near, lambda pairs: pairs, "simhash").withColumnRenamed("item", "fp"), "simhash-roots")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of documents (doc_id, text)."""
    hashed = keep(docs.select("doc_id", simhash("text").alias("fp")), "simhash")
    groups = hashed.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    groups = keep(groups, "simhash-groups")
    named = groups.join(fingerprint_roots(groups.select("fp")), "fp")
    smallest = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = keep(named.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "simhash-components")
    return hashed.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(data: bytes | None, width: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending; a shorter text is one shingle."""
    words = (data or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n, found = max(1, len(words) - width + 1), []
    for i in range(0, n, 1 << 16):
        found.append(np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[j : j + width]), SEED) for j in range(i, min(n, i + (1 << 16)))], np.uint64)))
    return np.unique(np.concatenate(found))


def _shingled(width: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sets(texts: pa.Array) -> pa.Array:
        memory("simhash")
        return pa.array([shingles(t.as_py(), width).view(np.int64) for t in texts.cast(pa.large_binary())], pa.list_(pa.int64()))

    return sets


def _print(x: np.ndarray) -> int:
    """SimHash of hashes, each once, as a signed long."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(x), 1 << 16):
        ones += np.unpackbits(x[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(x)).view(">i8")[0])


def _parities(x: np.ndarray) -> list[int]:
    """Whether odd numbers of hashes, each once, fall in each of 64 * PARITIES places: sets differ in as many hashes as parities, at least."""
    odd = np.bincount((x % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").tolist()


def _prefixed(width: int, alike: tuple[int, int], hot: np.ndarray):
    """UDF of (set, n, print, print2, parities, prefix): a hash of the text's set of shingles, its size, SimHashes, parities and first shingles; hot ones come last, in their order."""
    place = np.argsort(hot)
    known = hot[place]
    kinds = [("set", T.LongType()), ("n", T.IntegerType()), ("print", T.LongType()), ("print2", T.LongType()), ("parities", T.ArrayType(T.LongType())), ("prefix", T.ArrayType(T.LongType()))]

    @F.arrow_udf(T.StructType([T.StructField(n, t) for n, t in kinds]))
    def prefixes(texts: pa.Array) -> pa.Array:
        memory("simhash")
        sets, sizes, prints, others, parities, first = [], [], [], [], [], []
        for t in texts.cast(pa.large_binary()):
            x = shingles(t.as_py(), width)
            sets.append(xxhash.xxh64_intdigest(x.astype("<u8").tobytes(), SEED))
            sizes.append(len(x))
            prints.append(_print(x))
            others.append(_print(x * np.uint64(0x9E3779B97F4A7C15) ^ x >> np.uint64(32)))
            parities.append(_parities(x))
            if len(known) and len(x):
                at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                common = known[at] == x
                x = np.concatenate([x[~common], hot[np.sort(place[at[common]])]])
            first.append(x[: len(x) + alike[0] * len(x) // -alike[1] + 1].view(np.int64))
        give_back()
        return pa.StructArray.from_arrays([pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(others, pa.int64()), pa.array(parities, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))], [n for n, _ in kinds])

    return prefixes


def _can_be_alike(x: Column, y: Column, alike: tuple[int, int]) -> Column:
    """Whether sets of so many items (x[2], y[2]), of which at least so many are in no other set (x[3], y[3]), of such parities (from x[4], y[4]), can be alike."""
    more = x[2] - y[2]
    apart = F.greatest(2 * F.greatest(x[3], y[3] + more) - more, _apart(x, y, PARITIES, 4))  # items in one of both only, at least
    whole = x[2] + y[2]
    return (alike[1] * F.least(x[2], y[2]) >= alike[0] * F.greatest(x[2], y[2])) & (alike[1] * (whole - apart) >= alike[0] * (whole + apart))


def _alike(texts: DataFrame, rows: DataFrame, width: int, alike: tuple[int, int]) -> Callable[[DataFrame], DataFrame]:
    """The pairs (a, b) of items that are alike: rows (item, row), texts (row, text), a row for each item."""

    def links(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("item")).union(pairs.select("b")).distinct()
        sets = keep(texts.join(rows.select("item", "row").join(wanted, "item"), "row").dropDuplicates(["item"]).select("item", _shingled(width)("text").alias("items")), "alike-sets")
        x, y = (sets.select(F.col("item").alias(c), F.col("items").alias(f"{c}_items")) for c in "ab")
        both = F.size(F.array_intersect("a_items", "b_items"))
        return keep(pairs.join(x, "a").join(y, "b").where(alike[1] * both >= alike[0] * (F.size("a_items") + F.size("b_items") - both)).select("a", "b"), "alike-links")

    return links


def _identity(docs: DataFrame):
    """Of equal rows the same, of others not: two 64-bit hashes of all columns."""
    columns = [F.to_json(F.struct(F.col(quoted(c)).alias("x"))) if isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType)) else F.col(quoted(c)) for c in docs.columns]
    return F.struct(F.xxhash64(F.lit(1), *columns).alias("x"), F.xxhash64(F.lit(2), *columns).alias("y"))


def deduplicate(docs: DataFrame, width: int = WORDS, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """One row of docs for each component, with its columns; fingerprints within BITS link, and sets of shingles that are alike."""
    rows = docs.select(_identity(docs).alias("row"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("packed")).select("row", "packed", F.col("packed.doc_id").alias("doc_id"), F.col("packed.text").alias("text"))
    with scratch(docs.sparkSession) as lasting:
        chosen = lasting(_chosen(rows, width, alike), "simhash-chosen")
    kept = rows.select("row", "packed").join(chosen, "row")
    return kept.where("many is null").select("packed").union(kept.where("many").dropDuplicates(["row"]).select("packed")).select("packed.*")


def _chosen(rows: DataFrame, width: int, alike: tuple[int, int]) -> DataFrame:
    """(row, many) of the rows (row, doc_id, text) that stay; many: there are several equal ones."""
    often = rows.where(F.pmod(F.xxhash64("doc_id", "row"), F.lit(SAMPLE)) == 0).select(F.explode(_shingled(width)("text")).alias("key")).groupBy("key").count().where(F.col("count") >= SAMPLE_LEAST)
    hot = often.orderBy(F.desc("count"), "key").limit(HOT).toArrow().column("key").to_numpy().view(np.uint64)[::-1].copy()
    hashed = keep(rows.select("doc_id", "row", simhash("text").alias("fp"), _prefixed(width, alike, hot)("text").alias("s")).select("doc_id", "row", "fp", "s.*"), "simhash")
    narrow = hashed.select("doc_id", "row", "fp", "set", "n")
    groups = keep(narrow.groupBy("fp", "set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")).alias("first")), "simhash-groups")
    named = keep(groups.join(fingerprint_roots(groups.select("fp").distinct()), "fp").select("set", "root", "first"), "simhash-named")
    one = keep(groups.groupBy("set").agg(F.min("first.row").alias("row")).withColumn("item", F.monotonically_increasing_id()), "alike-numbers")
    index = keep(narrow.join(one, ["set", "row"]).dropDuplicates(["item"]).select("item", "set", "n", "row"), "alike-items")
    # a set belongs to the component of its text's fingerprint; where texts of one set have several, it joins them
    least = named.groupBy("set").agg(F.min("root").alias("a"))
    tops = components(named.join(least, "set").select("a", F.col("root").alias("b")))
    known = keep(index.join(least, "set").join(tops.select(F.col("v").alias("a"), F.col("root").alias("top")), "a", "left").select("item", "set", F.coalesce("top", "a").alias("root")), "alike-known")
    numbered = hashed.join(one, ["set", "row"]).dropDuplicates(["item"])
    about = keep(numbered.select("item", "print", "print2", F.col("n").cast("long").alias("n"), "parities", F.size("prefix").alias("first")), "alike-about")
    prefix = numbered.select(F.explode("prefix").alias("key"), "item")
    shared = keep(prefix.groupBy("key").agg(F.min("item").alias("low"), F.max("item").alias("high")).where("low < high").select("key"), "alike-shared")
    met = keep(prefix.join(shared, "key"), "alike-met")
    told = about.join(met.groupBy("item").agg(F.count("*").alias("shared")), "item").select("item", F.concat(F.array("print", "print2", "n", F.col("first") - F.col("shared")), "parities").alias("print"))  # before the parities: first shingles that no other set has
    index_of = keep(met.join(told, "item").select("key", "item", "print"), "alike-index")
    entries = lambda rows: whole(index_of).join(rows, "item").select("key", "item", "print", "root")
    near = lambda x, y, key: (_apart(x, y, 2) <= FAR) & _can_be_alike(x, y, alike)
    own = _roots(known.select("item", "root"), entries, near, _alike(rows.select("row", "text"), index, width, alike), "alike")
    final = named.join(known.select("set", "item").join(own, "item").select("set", F.col("root").alias("top")), "set")
    stay = final.groupBy("top").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    many = narrow.groupBy("row").count().where("count > 1").select("row", F.lit(True).alias("many"))
    return stay.distinct().join(many, "row", "left")
