"""Language-model scores by a hierarchical Pitman-Yor model with sampled Chinese-restaurant seatings.

Every context, the previous word by its 64-bit hash, has a restaurant that seats the words following it; each of its tables
sends a customer to the one parent restaurant that all contexts share, whose base is uniform over the known words and
one unknown. Seatings are Gibbs-sampled: with the others fixed, the number of tables of c customers of one dish is
drawn from its conditional, by generalised Stirling numbers up to EXACT customers and by the conditional's saddle point beyond.
A sweep uses the totals of the sweep before, as is usual for distributed Gibbs sampling. After BURN_IN sweeps, predictive
probabilities are averaged over the rest, and a text's score is the sum of their logarithms; perplexity is
10 ** (-score / n_tokens). Random numbers come from hashes of (word, context, sweep): results depend neither on how rows
are dealt to tasks nor on a lost task's second run, but for the order in which doubles are added.

How it scales. Three kinds of groups, each of bounded size, exchange messages by shuffles; nothing but a dozen totals and the
hashes of hot contexts (HOT for each part at most) reaches the driver.

* A chunk holds up to CHUNK_TOKENS tokens of whole texts, a longer text being cut into pieces, as numbers into its own words.
  It is written once. It tells the parts of its distinct (context, word) pairs and their counts, and is told how all of the corpus seats them.
* A part holds about PART_ENTRIES such pairs, those of the contexts hashed to it, counted over all chunks. A hot context is
  spread over parts by its words. Pairs are combined within chunks first, so that a part's size does not follow a pair's frequency.
* A bucket holds the parent restaurant's words in a range of hashes, and the totals of hot contexts. Parts send it
  their sums, and it sends what all of them add up to.

Messages are whole numbers, counts of customers and tables; probabilities are computed in the chunks, and nothing is rounded. There
are no more numbers than distinct pairs in chunks, or words in parts, so they grow in proportion to the text. Chunks and
parts are written in buckets of their number, so that replies travel to them and they stay where they are.

Defined results: null and empty texts consist of the end alone; rows are scored each, also where ids repeat or are
null; without training texts every probability is the base's, 1; an empty table gives an empty result. Only doc_id and
text are read, so other columns do not matter. One word is held in memory whole, however long.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, give_back, keep, keep_grouped

HELD_OUT = (7, 2)
SWEEPS, BURN_IN = 4, 1
STRENGTH, SEED = 1.0, 11
EXACT = 256
CHUNK_TOKENS, CHUNK_DOCS, PART_ENTRIES, LEAST_PARTS = 1_500_000, 60_000, 1_000_000, 8
#: Parts for each bucket; share of a part at which a context is hot, and the fewest of its pairs in a chunk that count towards it.
BUCKET_PARTS, HOT, HOT_PAIRS = 4, 4, 16
PIECE = 1 << 22
END, BEGIN = b" end", b" begin"  # no word holds a space
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MIX, _MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# --- arrays on the wire


def _planes(x: np.ndarray) -> np.ndarray:
    """Non-negative whole numbers as planes of their bytes, of which the upper ones compress to nothing."""
    return np.ascontiguousarray(x.astype("<i8").view("u1").reshape(-1, 8).T)


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays of hashes (unsigned) and of non-negative whole numbers, compressed; the lengths lead."""
    raw = [np.ascontiguousarray(a, "<u8") if a.dtype == np.uint64 else _planes(a) for a in arrays]
    body = b"".join([np.array([a.nbytes for a in raw], "<i8").tobytes(), *(a.tobytes() for a in raw)])
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unzip(data: bytes, kinds: str) -> list[np.ndarray]:
    """The arrays of ``_zip``; kinds has an h for hashes and an n for numbers."""
    body = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 8 * len(kinds)
    for size, kind in zip(np.frombuffer(body, "<i8", len(kinds)).tolist(), kinds):
        raw = np.frombuffer(body, "u1", size, at)
        out.append(raw.view("<u8") if kind == "h" else np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel())
        at += size
    return out


def _cut(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary value for each slice between bounds."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _narrow(values: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Slices of non-negative numbers as bytes, and of those from 255 on in full."""
    large = values >= 255
    return [_cut(np.minimum(values, 255).astype("u1"), bounds), _cut(values[large].astype("<i8"), _bounds(large)[bounds])]


def _joined(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), kind)


def _widened(column, more) -> np.ndarray:
    """The numbers of ``_narrow``, one after another."""
    out = _joined(column, "u1").astype(np.int64)
    out[out == 255] = _joined(more, "<i8")
    return out


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _sizes(column, width: int) -> np.ndarray:
    """Numbers of values of so many bytes in each binary value."""
    return np.array([len(x) // width for x in column.to_pylist()], np.int64)


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX_2
    return x ^ (x >> np.uint64(32))


def _pair(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return _hash(words ^ _hash(contexts + np.uint64(1)))


def uniform(keys: np.ndarray, sweep: int, salt: int) -> np.ndarray:
    """A number in (0, 1) for each 32-bit key, by sweep and salt."""
    x = _hash(_hash(keys.astype(np.uint64) + (np.uint64(SEED) << np.uint64(32))) ^ np.uint64(2 * sweep + salt))
    return ((x >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


# --- seating


def _log_stirling(discount: float, most: int) -> np.ndarray:
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 1)
        s[c + 1, 1 : c + 1] = np.logaddexp(s[c, :c], np.log(c - discount * t) + s[c, 1 : c + 1])
        s[c + 1, c + 1] = s[c, c]
    return s


def _seat_many(c: np.ndarray, log_w: np.ndarray, discount: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Tables of many customers: tables are clusters of a Poisson process tilted so that their expected sum is c (a saddle point), taken
    as Poisson where few and normal with the variance given the sum where many."""
    lo, hi = np.full(len(c), -60.0), np.full(len(c), 60.0)  # logit of the tilt z: w z (1 - z)^(discount - 1) = c
    for _ in range(60):
        m = (lo + hi) / 2
        low = log_w - np.logaddexp(0, -m) - (discount - 1) * np.logaddexp(0, m) < np.log(c)
        lo, hi = np.where(low, m, lo), np.where(low, hi, m)
    log_rest, z = -np.logaddexp(0, m), 1 / (1 + np.exp(-m))
    mean = np.exp(log_w) * -np.expm1(discount * log_rest) / discount
    spread = np.exp(log_w) * (z * np.exp((discount - 1) * log_rest) + z * z * (1 - discount) * np.exp((discount - 2) * log_rest))
    deviation = np.sqrt(np.maximum(mean - c * c / np.maximum(spread, 1e-300), 1e-12))
    many = np.rint(mean + (1 - mean / c) + deviation * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v))
    rate = np.minimum(mean, 20)
    few, p, total = np.zeros(len(c)), np.exp(-rate), np.exp(-rate)
    for k in range(1, 80):  # the inverse of the Poisson distribution
        few += total < u
        p = p * rate / k
        total = total + p
    return np.clip(np.where(mean < 20, 1 + few, many), 1, c).astype(np.int64)


_stirling: dict[float, np.ndarray] = {}


def seated(c: np.ndarray, weight: np.ndarray, discount: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Tables of c customers of one dish each, where a new table weighs ``weight`` and a table of n customers n - discount; u and v are uniform."""
    if discount not in _stirling:
        _stirling.clear()
        _stirling[discount] = _log_stirling(discount, EXACT)
    t = np.minimum(c, 1).astype(np.int64)
    log_w = np.log(np.maximum(weight, 1e-300))
    few = np.minimum(c, EXACT + 1)
    order = np.argsort(few, kind="stable")
    values, start = np.unique(few[order], return_index=True)
    for n, a, b in zip(values.tolist(), start, [*start[1:], len(order)]):
        if not 2 <= n <= EXACT:
            continue
        step = (1 << 18) // n
        for k in range(a, b, step):
            mine = order[k : min(b, k + step)]
            logs = _stirling[discount][n, 1 : n + 1] + np.outer(log_w[mine], np.arange(1, n + 1))
            p = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
            t[mine] = 1 + (p < u[mine][:, None] * p[:, -1:]).sum(axis=1)
    big = (c > EXACT).nonzero()[0]
    if len(big):
        t[big] = _seat_many(c[big].astype(float), log_w[big], discount, u[big], v[big])
    return t


def seat(c: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    return seated(c, weight, discount, rng.random(len(c)), rng.random(len(c)))


class Totals(NamedTuple):
    """What all groups need to know: of training its tokens, its distinct words and both discounts; of a sweep customers and tables of the parent."""

    tokens: int
    vocabulary: int
    discount: float
    parent_discount: float
    customers: int
    tables: int

    def base_weight(self) -> float:
        return (STRENGTH + self.parent_discount * self.tables) / (self.vocabulary + 1)

    def parent(self, customers, tables):
        """Parent probabilities of words that have so many customers and tables there."""
        return (np.maximum(customers - self.parent_discount * tables, 0) + self.base_weight()) / (STRENGTH + self.customers)

    def predictive(self, count, tables, context_customers, context_tables, parent):
        """Probability of a word that a context has seated count times at so many tables."""
        return (np.maximum(count - self.discount * tables, 0) + (STRENGTH + self.discount * context_tables) * parent) / (STRENGTH + context_customers)


# --- chunks


class _Chunk:
    """Texts or pieces of them, as numbers of the chunk's words."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.rows: list[tuple] = []  # row, doc_id, held out, length, number of the word before
        self.texts: list[np.ndarray] = []
        self.tokens = 0

    def add(self, row: int, doc_id, held: bool, words: list[bytes], before: bytes) -> None:
        self.rows.append((row, doc_id, held, len(words), self.number[before]))
        self.texts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.tokens += len(words)

    def full(self, tokens: int) -> bool:
        return self.tokens >= tokens or len(self.rows) >= CHUNK_DOCS

    def record(self, name: int) -> pa.RecordBatch:
        """Words are numbered in the order of their hashes."""
        hashes = np.array([xxhash.xxh64_intdigest(x) for x in self.number], np.uint64)
        self.number.clear()
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        hashes, tokens = hashes[order], place[np.concatenate(self.texts)]
        self.texts.clear()
        row, ids, held, length, before = zip(*self.rows)
        before = place[list(before)]
        pairs = np.unique(_keys(tokens, np.array(length), before))
        contexts, followers = np.unique(pairs >> 32, return_counts=True)
        often = followers >= HOT_PAIRS
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name], pa.int64()), pa.array([row], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([_zip(hashes, tokens, np.array(length), before)], pa.binary()),
                pa.array([len(pairs)], pa.int64()), pa.array([hashes[contexts[often]].view(np.int64)], pa.list_(pa.int64())), pa.array([followers[often]], pa.list_(pa.int64())),
            ],
            names=["chunk", "row", "ids", "held", "data", "pairs", "often", "followers"],
        )


_CHUNK = "chunk long, row array<long>, ids array<long>, held array<boolean>, data binary, pairs long, often array<long>, followers array<long>"


def _pieces(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text and its end, in pieces of about so many bytes; A to Z only are lowered, and split() cuts at the asked white space."""
    at = 0
    while len(text) - at > size:
        m = _SPACE.search(text, at + size)
        stop = m.start() if m else len(text)
        yield text[at:stop].lower().split()
        at = stop
    yield [*text[at:].lower().split(), END]


def _chunks(docs: DataFrame, tokens: int, piece: int) -> DataFrame:
    """The texts of docs (doc_id, held_out, text), each token as its number."""

    def rows(batches):
        chunk, names, row = _Chunk(), count(TaskContext.get().partitionId() << 32), count(TaskContext.get().partitionId() << 40)
        for b in batches:
            for i, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary())):
                number, before = next(row), BEGIN
                for words in _pieces(text.as_py() or b"", piece):
                    if words:
                        chunk.add(number, i, held, words, before)
                        before = words[-1]
                    if chunk.full(tokens):
                        yield chunk.record(next(names))
                        chunk = _Chunk()
                        give_back()
        if chunk.rows:
            yield chunk.record(next(names))
        del chunk
        give_back()

    return keep_grouped(docs.mapInArrow(rows, _CHUNK), "chunks", "chunk")


def _keys(tokens: np.ndarray, length: np.ndarray, before: np.ndarray) -> np.ndarray:
    """context << 32 | word of each token."""
    u = np.roll(tokens, 1)
    u[np.cumsum(length) - length] = before
    return u << 32 | tokens


class _Pairs:
    """A chunk's distinct pairs, in the order in which parts are told of them: by part, context and word."""

    def __init__(self, data: bytes, parts: int, hot: np.ndarray) -> None:
        self.hashes, tokens, self.length, before = _unzip(data, "hnnn")
        keys, at = np.unique(_keys(tokens, self.length, before), return_inverse=True)
        u, w = keys >> 32, keys & 0xFFFFFFFF
        part = (_hash(self.hashes) % np.uint64(parts)).astype(np.int32)[u]
        spread = np.isin(self.hashes, hot)[u]
        part[spread] = _pair(self.hashes[u[spread]], self.hashes[w[spread]]) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.at = place[at]  # of each token
        self.part, self.context, self.word = part[order], u[order], w[order]
        self.edge = np.concatenate([[True], self.part[1:] != self.part[:-1]])
        self.head = self.edge | np.concatenate([[True], self.context[1:] != self.context[:-1]])
        first = np.zeros(len(self.hashes), np.int64)
        first[self.word[::-1]] = np.arange(len(order))[::-1]
        self.asks = np.zeros(len(order), bool)  # one pair of each word asks for the word's count
        self.asks[first[self.word]] = True


def _requests(chunks: DataFrame, parts: int, shared) -> DataFrame:
    """part, chunk, contexts, followers, words of its pairs, 2 * training count + whether it asks."""

    def rows(batches):
        for b in batches:
            for chunk, held, data in zip(*b.columns):
                pairs = _Pairs(data.as_py(), parts, shared.value)
                taught = np.repeat(~np.array(held.as_py()), pairs.length)
                value = 2 * np.bincount(pairs.at[taught], minlength=len(pairs.part)) + pairs.asks
                start, heads = pairs.edge.nonzero()[0], pairs.head.nonzero()[0]
                bounds = np.append(start, len(value))
                context_bounds = np.searchsorted(heads, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pairs.part[start]), pa.array([chunk.as_py()] * len(start), pa.int64()), _cut(pairs.hashes[pairs.context[heads]], context_bounds), _cut(np.diff(np.append(heads, len(value))).astype("<u4"), context_bounds),
                        _cut(pairs.hashes[pairs.word], bounds), *_narrow(value, bounds),
                    ],
                    names=["part", "chunk", "contexts", "followers", "words", "counts", "more"],
                )
                del pairs, taught, value
                give_back()

    return chunks.select("chunk", "held", "data").mapInArrow(rows, "part int, chunk long, contexts binary, followers binary, words binary, counts binary, more binary")


# --- parts


def _parts(requests: DataFrame, shared) -> DataFrame:
    """A row for each part.

    keys: hashes of its words, their training counts and numbers of pairs; hashes of its contexts. live: context, word and count of each repeated
    pair; each context's customers and single pairs; single pairs of words; numbers of hot contexts, their pairs. pairs: context, word and count
    of all. chunk, sizes, routes: the pairs that each chunk sent, and whether they ask. ones, twos: pairs of so many customers.
    """

    def merge(key, table):
        table = table.sort_by("chunk")
        sizes = _sizes(table.column("counts"), 1)
        value = _widened(table.column("counts"), table.column("more"))
        words, w = np.unique(_joined(table.column("words"), "<u8"), return_inverse=True)
        contexts, u = np.unique(_joined(table.column("contexts"), "<u8"), return_inverse=True)
        u = np.repeat(u, _joined(table.column("followers"), "<u4"))
        pairs, at = np.unique(u << 32 | w, return_inverse=True)
        del u, w
        c = np.bincount(at, value >> 1, len(pairs)).astype(np.int64)
        u, w = pairs >> 32, pairs & 0xFFFFFFFF
        single, repeated, some = c == 1, c > 1, c > 0
        hot = np.isin(contexts, shared.value).nonzero()[0]
        live = _zip(u[repeated], w[repeated], c[repeated], _sums(u, c, contexts), _sums(u[single], None, contexts), _sums(w[single], None, words), hot, _sums(u[some], None, contexts)[hot])
        step = np.diff(at, prepend=0)
        first = _bounds(sizes)[:-1]
        step[first] = at[first]
        row = {
            "part": [key[0].as_py()], "keys": [_zip(words, _sums(w, c, words), _sums(w[some], None, words), contexts)], "live": [live], "pairs": [_zip(np.diff(u, prepend=0), w, c)],
            "ones": [int(single.sum())], "twos": [int((c == 2).sum())], "chunk": [table.column("chunk").to_pylist()], "sizes": [sizes], "routes": [_zip(step, value & 1)],
        }
        del at, step, value, pairs, table
        give_back()
        return pa.table(row, schema=schema)

    binary, numbers = pa.binary(), pa.list_(pa.int64())
    schema = pa.schema([("part", pa.int32()), ("keys", binary), ("live", binary), ("pairs", binary), ("ones", pa.int64()), ("twos", pa.int64()), ("chunk", numbers), ("sizes", numbers), ("routes", binary)])
    kind = "part int, keys binary, live binary, pairs binary, ones long, twos long, chunk array<long>, sizes array<long>, routes binary"
    return keep_grouped(requests.groupBy("part").applyInArrow(merge, kind), "parts", "part")


def _sums(at: np.ndarray, values: np.ndarray | None, of: np.ndarray) -> np.ndarray:
    return np.bincount(at, values, len(of)).astype(np.int64)


class _Seating:
    """A part's repeated pairs and contexts."""

    def __init__(self, row: dict) -> None:
        self.context, self.word, self.count, self.customers, self.alone, self.word_alone, self.hot, self.hot_pairs = _unzip(row["live"], "nnnnnnnn")
        self.words, self.counts, self.word_pairs, self.contexts = _unzip(row["keys"], "hnnh")
        self.tables = np.ones(len(self.word), np.int64)

    def random(self) -> np.ndarray:
        return _pair(self.contexts[self.context], self.words[self.word]) >> np.uint64(32)

    def own_tables(self) -> np.ndarray:
        return self.alone + _sums(self.context, self.tables, self.contexts)

    def context_tables(self, hot: np.ndarray) -> np.ndarray:
        out = self.own_tables()
        out[self.hot] = hot
        return out


def _introduced(parts: DataFrame, buckets: int) -> DataFrame:
    """Each part's words and hot contexts, to the buckets of their hashes, which rise with the hashes."""
    bucket = lambda x: ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)

    def rows(batches):
        for b in batches:
            for part, keys, live in zip(*b.columns):
                s = _Seating({"keys": keys.as_py(), "live": live.as_py()})
                hot = s.contexts[s.hot]
                at, hot_at = bucket(s.words), bucket(hot)
                told = np.union1d(at, hot_at)
                bounds, hot_bounds = (np.append(np.searchsorted(x, told), len(x)) for x in (at, hot_at))
                cut = [_cut(s.words, bounds), *_narrow(np.column_stack([s.counts, s.word_pairs]).ravel(), 2 * bounds), _cut(hot, hot_bounds), _cut(np.column_stack([s.customers[s.hot], s.hot_pairs]).ravel(), 2 * hot_bounds)]
                yield pa.RecordBatch.from_arrays([pa.array(told, pa.int32()), pa.array([part.as_py()] * len(told), pa.int32()), *cut], names=["bucket", "part", "words", "sums", "more", "hot", "hot_sums"])

    return parts.select("part", "keys", "live").mapInArrow(rows, "bucket int, part int, words binary, sums binary, more binary, hot binary, hot_sums binary")


_STATE = "bucket int, part int, parts array<int>, sizes array<long>, hot_sizes array<long>, state binary, totals array<long>, words binary, more binary, hot binary"
_ARROW = pa.schema(
    [("bucket", pa.int32()), ("part", pa.int32()), ("parts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int64())), ("hot_sizes", pa.list_(pa.int64())), ("state", pa.binary()), ("totals", pa.list_(pa.int64()))]
    + [(x, pa.binary()) for x in ("words", "more", "hot")]
)


def _replies(bucket: int, own: dict, parts: list[int], sizes, hot_sizes, place: np.ndarray, hot_place: np.ndarray, words: list[np.ndarray], hot: list[np.ndarray]) -> pa.Table:
    """A bucket's own row, and for each part a row of the numbers of its words, a word's numbers together, and of its hot contexts."""
    first = pa.table({f.name: pa.array([own.get(f.name)], f.type) for f in _ARROW} | {"bucket": pa.array([bucket], pa.int32())}, schema=_ARROW)
    n, small, more = len(parts), *_narrow(np.column_stack([x[place] for x in words]).ravel(), len(words) * _bounds(sizes))
    given = {"bucket": pa.array([bucket] * n, pa.int32()), "part": pa.array(parts, pa.int32()), "words": small, "more": more, "hot": _cut(np.column_stack([x[hot_place] for x in hot]).ravel(), len(hot) * _bounds(hot_sizes))}
    return pa.concat_tables([first, pa.table([given.get(f.name, pa.nulls(n, f.type)) for f in _ARROW], schema=_ARROW)])


def _registered(introduced: DataFrame) -> DataFrame:
    """Each bucket's state and totals (tokens, words, words of one pair, of two, customers, tables). Its replies, where every pair has one
    table: customers, tables and training counts of words, tables and customers of hot contexts."""

    def meet(key, table):
        table = table.sort_by("part")
        sizes, hot_sizes = _sizes(table.column("words"), 8), _sizes(table.column("hot"), 8)
        words, place = np.unique(_joined(table.column("words"), "<u8"), return_inverse=True)
        hot, hot_place = np.unique(_joined(table.column("hot"), "<u8"), return_inverse=True)
        told, hot_told = _widened(table.column("sums"), table.column("more")), _joined(table.column("hot_sums"), "<i8")
        counts, pairs = (_sums(place, told[k::2], words) for k in (0, 1))
        hot_customers, hot_tables = (_sums(hot_place, hot_told[k::2], hot) for k in (0, 1))
        tables = np.minimum(pairs, 1)
        parts = table.column("part").to_pylist()
        own = {
            "parts": parts, "sizes": sizes, "hot_sizes": hot_sizes, "state": _zip((_hash(words) >> np.uint64(32)).astype(np.int64), place, hot_place),
            "totals": [int(counts.sum()), int((counts > 0).sum()), int((pairs == 1).sum()), int((pairs == 2).sum()), int(pairs.sum()), int(tables.sum())],
        }
        give_back()
        return _replies(key[0].as_py(), own, parts, sizes, hot_sizes, place, hot_place, [pairs, tables, counts], [hot_tables, hot_customers])

    return keep(introduced.groupBy("bucket").applyInArrow(meet, _STATE), "registered")


def _first(table: pa.Table, column: str) -> dict:
    """The row where a column isn't null."""
    return table.filter(pc.is_valid(table.column(column))).to_pylist()[0]


def _told(table: pa.Table, sweep: int) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Numbers of words (a row each) and of hot contexts (likewise) that buckets sent after a sweep, and their rows."""
    mine = table.filter(pc.and_(pc.is_valid(table.column("bucket")), pc.equal(table.column("sweep"), sweep))).sort_by("bucket")
    return _widened(mine.column("words"), mine.column("more")).reshape(-1, 2 if sweep else 3), _joined(mine.column("hot"), "<i8").reshape(-1, 1 if sweep else 2), mine


def _sent_to_parts(answered: DataFrame, k: int) -> DataFrame:
    return answered.where("part is not null").select("part", "bucket", "words", "more", "hot", F.lit(None).cast("binary").alias("seats"), F.lit(k).alias("sweep"))


def _kept_seats(swept: DataFrame, k: int) -> DataFrame:
    none = F.lit(None).cast("binary")
    return swept.where("bucket is null").select("part", "bucket", none.alias("words"), none.alias("more"), none.alias("hot"), "seats", F.lit(k).alias("sweep"))


def _seats(table: pa.Table, sweep: int) -> np.ndarray:
    return _unzip(_first(table.filter(pc.equal(table.column("sweep"), sweep)), "seats")["seats"], "n")[0]


def _swept(parts: DataFrame, answered: DataFrame, swept: DataFrame | None, k: int, totals: Totals) -> DataFrame:
    """Parts' seats after sweep k (part, seats), and their sums to buckets (bucket, part, sums, more, hot_sums)."""

    def sweep(key, own, table):
        s = _Seating(own.to_pylist()[0])
        if k > 1:
            s.tables = _seats(table, k - 1)
        words, hot, rows = _told(table, k - 1)
        parent = totals.parent(words[:, 0], words[:, 1])
        others = np.maximum(s.context_tables(hot[:, 0])[s.context] - s.tables, 0)
        random = s.random()
        s.tables = seated(s.count, (STRENGTH + totals.discount * others) * parent[s.word], totals.discount, uniform(random, k, 0), uniform(random, k, 1))
        n, part, per = rows.num_rows, key[0].as_py(), words.shape[1]
        sums = _narrow(s.word_alone + _sums(s.word, s.tables, s.words), _bounds(_sizes(rows.column("words"), per)))
        hot_sums = _cut(s.own_tables()[s.hot], _bounds(_sizes(rows.column("hot"), 8 * hot.shape[1])))
        none = pa.nulls(1, pa.binary())
        mine = pa.table([pa.array([None], pa.int32()), pa.array([part], pa.int32()), pa.array([_zip(s.tables)], pa.binary()), none, none, none], schema=schema)
        sent = pa.table([rows.column("bucket"), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.binary()), *sums, hot_sums], schema=schema)
        give_back()
        return pa.concat_tables([mine, sent])

    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("seats", pa.binary()), ("sums", pa.binary()), ("more", pa.binary()), ("hot_sums", pa.binary())])
    told = _sent_to_parts(answered, k - 1)
    if swept is not None:
        told = told.union(_kept_seats(swept, k - 1))
    found = parts.select("part", "keys", "live").groupBy("part").cogroup(told.groupBy("part")).applyInArrow(sweep, "bucket int, part int, seats binary, sums binary, more binary, hot_sums binary")
    return keep(found, "swept")


def _answered(registered: DataFrame, swept: DataFrame, k: int, totals: Totals) -> DataFrame:
    """Buckets' totals after sweep k (customers, tables), and their replies: customers and tables of words, tables of hot contexts."""

    def meet(key, table):
        own = _first(table, "state")
        sent = table.filter(pc.is_valid(table.column("part"))).sort_by("part")
        random, place, hot_place = _unzip(own["state"], "nnn")
        customers = _sums(place, _widened(sent.column("sums"), sent.column("more")), random)
        hot = np.bincount(hot_place, _joined(sent.column("hot_sums"), "<i8")).astype(np.int64)
        tables = seated(customers, np.full(len(customers), totals.base_weight()), totals.parent_discount, uniform(random, k, 2), uniform(random, k, 3))
        give_back()
        return _replies(key[0].as_py(), {"totals": [int(customers.sum()), int(tables.sum())]}, own["parts"], own["sizes"], own["hot_sizes"], place, hot_place, [customers, tables], [hot])

    rows = registered.where("part is null").select("bucket", "parts", "sizes", "hot_sizes", "state").unionByName(swept.where("bucket is not null").select("bucket", "part", "sums", "more", "hot_sums"), allowMissingColumns=True)
    return keep(rows.groupBy("bucket").applyInArrow(meet, _STATE), "answered")


_SEATED = ("pairs", "repeated", "contexts", "words")


def _known(parts: DataFrame, registered: DataFrame, samples: list[tuple[int, DataFrame, DataFrame, Totals]]) -> DataFrame:
    """chunk, part, and narrow numbers: the count of each pair that the chunk told of; the tables of repeated ones, of all samples together; customers
    of their contexts and tables in samples; of words asked for counts, then customers and tables in samples."""
    sweeps = [k for k, *_ in samples]

    def answer(key, own, table):
        own = own.to_pylist()[0]
        s, (gaps, w, c), (at, asks) = _Seating(own), _unzip(own["pairs"], "nnn"), _unzip(own["routes"], "nn")
        u, sizes = np.cumsum(gaps), np.array(own["sizes"], np.int64)
        first, hot, _ = _told(table, 0)
        s.customers = s.customers.copy()
        s.customers[s.hot] = hot[:, 1]
        words, contexts, tables = [first[:, 2]], [s.customers], []
        for k in sweeps:
            s.tables = _seats(table, k)
            told, hot, _ = _told(table, k)
            words += [told[:, 0], told[:, 1]]
            contexts.append(s.context_tables(hot[:, 0]))
            tables.append(s.tables)
        bounds = _bounds(sizes)
        at = np.cumsum(at)  # the steps of each chunk begin anew
        at -= np.repeat(np.concatenate([[0], at])[bounds[:-1]], sizes)
        times, head = c[at], np.concatenate([[True], u[at][1:] != u[at][:-1]])
        head[bounds[:-1]] = True
        repeated, asking = times > 1, asks > 0
        place = np.cumsum(c > 1) - 1
        cut = [*_narrow(times, bounds)]
        for values, rows, mask in ((tables, place[at[repeated]], repeated), (contexts, u[at[head]], head), (words, w[at[asking]], asking)):
            cut += _narrow(np.column_stack([x[rows] for x in values]).ravel(), len(values) * _bounds(mask)[bounds])
        out = pa.table([pa.array(own["chunk"], pa.int64()), pa.array([key[0].as_py()] * len(sizes), pa.int32()), *cut], names=["chunk", "part", *names])
        del own, s, gaps, u, w, c, at, asks, first, words, contexts, tables, times, head, repeated, asking, place, cut, table
        give_back()
        return out

    names = [f"{x}{more}" for x in _SEATED for more in ("", "_more")]
    told = _sent_to_parts(registered, 0)
    for k, swept, answered, _ in samples:
        told = told.union(_kept_seats(swept, k)).union(_sent_to_parts(answered, k))
    rows = parts.select("part", "keys", "live", "pairs", "chunk", "sizes", "routes")
    return rows.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(answer, f"chunk long, part int, {', '.join(f'{x} binary' for x in names)}")


def _scored(chunks: DataFrame, known: DataFrame, parts: int, shared, samples: list[Totals]) -> DataFrame:
    """row, doc_id, held_out, n_tokens, n_known, logs (of counts + 1), score of each text or piece."""

    def gather(key, own, told):
        own, told = own.to_pylist()[0], told.sort_by("part")
        pairs = _Pairs(own["data"], parts, shared.value)
        n = len(samples)
        count, repeated, contexts, words = (_widened(told.column(x), told.column(f"{x}_more")) for x in _SEATED)
        repeated, contexts, words = repeated.reshape(-1, n), contexts.reshape(-1, 1 + n), words.reshape(-1, 1 + 2 * n)
        context = np.cumsum(pairs.head) - 1
        word = np.zeros(len(pairs.hashes), np.int64)
        word[pairs.word[pairs.asks]] = np.arange(len(words))
        word = word[pairs.word]
        p, tables = np.zeros(len(count)), np.minimum(count, 1)
        for k, total in enumerate(samples):
            tables[count > 1] = repeated[:, k]
            parent = total.parent(words[:, 1 + 2 * k], words[:, 2 + 2 * k])
            p += total.predictive(count, tables, contexts[context, 0], contexts[context, 1 + k], parent[word])
        doc, docs = np.repeat(np.arange(len(pairs.length)), pairs.length), len(pairs.length)
        score = np.bincount(doc, np.log10(p / n)[pairs.at], docs)
        known, base = np.bincount(doc, (words[:, 0] > 0)[word][pairs.at], docs).astype(np.int64), np.bincount(doc, np.log10(words[:, 0] + 1.0)[word][pairs.at], docs)
        out = pa.table([pa.array(own["row"], pa.int64()), pa.array(own["ids"], pa.int64()), pa.array(own["held"], pa.bool_()), pa.array(pairs.length, pa.int64()), known, base, score], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score"])
        del own, told, pairs, count, repeated, contexts, words, context, word, p, tables, doc
        give_back()
        return out

    kind = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"
    return chunks.select("chunk", "row", "ids", "held", "data").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(gather, kind)


def _discount(ones: int, twos: int) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones + twos else 0.5


def _sum(frame: DataFrame, n: int) -> list[int]:
    """The sums of a table's totals."""
    return [x or 0 for x in frame.where("part is null").select(*[F.sum(F.col("totals")[i]) for i in range(n)]).first()]


def score(docs: DataFrame, sweeps: int = SWEEPS, burn_in: int = BURN_IN, chunk_tokens: int = CHUNK_TOKENS, piece: int = PIECE, part_entries: int = PART_ENTRIES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row of documents (doc_id, text)."""
    context = docs.sparkSession.sparkContext
    held = (fold("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out")
    chunks = _chunks(docs.select("doc_id", held, "text"), chunk_tokens, piece)
    entries = chunks.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    count_parts = max(LEAST_PARTS, -(-entries // part_entries))
    often = chunks.select(F.explode(F.arrays_zip("often", "followers")).alias("x")).groupBy("x.often").agg(F.sum("x.followers").alias("n"))
    hot = often.where(F.col("n") >= max(1, entries // count_parts // HOT)).select("often").toArrow().column(0).to_numpy().view(np.uint64)  # HOT for each part at most
    shared = context.broadcast(np.sort(hot))
    parts = _parts(_requests(chunks, count_parts, shared), shared)
    registered = _registered(_introduced(parts, -(-count_parts // BUCKET_PARTS)))
    tokens, vocabulary, once, twice, customers, tables = _sum(registered, 6)
    ones, twos = (x or 0 for x in parts.agg(F.sum("ones"), F.sum("twos")).first())
    totals = Totals(tokens, vocabulary, _discount(ones, twos), _discount(once, twice), customers, tables)
    swept, answered, samples = None, registered, []
    for k in range(1, sweeps + 1):
        swept = _swept(parts, answered, swept, k, totals)
        answered = _answered(registered, swept, k, totals)
        totals = totals._replace(**dict(zip(("customers", "tables"), _sum(answered, 2))))
        if k > burn_in:
            samples.append((k, swept, answered, totals))
    found = _scored(chunks, _known(parts, registered, samples), count_parts, shared, [x for *_, x in samples])
    whole = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "logs", "score")])
    base = F.col("logs") - F.col("n_tokens") * float(np.log10(tokens + vocabulary + 1))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
