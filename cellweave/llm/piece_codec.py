"""Exact SentencePiece encoding of merge-type models by backtracking, and decoding.

A token sequence is what merging would give exactly if every token re-merges to itself and every two neighbours,
concatenated and re-merged, come out as those two. The encoder therefore walks a text by Aho-Corasick longest matches,
checks each token against the one before, falls back to the token's next shorter prefix that is a token, and steps
back when none fits; a bitfield of positions from which no encoding fits keeps the walk linear. Merging itself runs
only on pairs not met before. Text is cut where no piece can cross (before a space that follows other text, and around
line ends if no piece holds one), and the parts met before are taken from a bounded memory in each worker.

Defined results: null is the empty text, which has only the end id; characters outside the vocabulary become byte
pieces (or the unknown id in models without them); long texts without spaces are encoded whole, in memory proportional to
their length. Rows are judged each by itself, so ties, repeated rows and other columns do not matter; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import memory, prepare

SPACE = "▁"
#: Parts and pairs remembered by a worker; beyond it, at the next text, the memory starts afresh. Longer parts than LONG are not kept.
REMEMBERED, LONG = 200_000, 48


class Model(NamedTuple):
    """What an encoder needs of a model file: a few MB at most, so it may be broadcast."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    whole: list[int]  # ids of normal pieces that merging their characters gives back
    prefix: bool
    end_id: int
    unknown_surface: str


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spec = proto.normalizer_spec
    if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("a merge-type model with identity normalisation is needed")
    if any(p.type in (4, 5) for p in proto.pieces) or any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces if p.type == 1):
        raise ValueError("user-defined or unused pieces, or pieces with inner spaces, are not supported")
    pieces, scores, kinds = [p.piece for p in proto.pieces], [p.score for p in proto.pieces], [p.type for p in proto.pieces]
    ids = {p: i for i, p in enumerate(pieces) if kinds[i] == 1}
    whole = [i for p, i in ids.items() if merge(p, ids, scores) == [p]]
    return Model(pieces, scores, kinds, whole, spec.add_dummy_prefix, pieces.index("</s>"), proto.trainer_spec.unk_surface)


def merge(text: str, ids: dict[str, int], scores: list[float]) -> list[str]:
    """Plain merging: the neighbours of the best-scored joint piece first, leftmost among equals."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            k = ids.get(parts[i] + parts[i + 1])
            if k is not None and (best is None or scores[k] > best):
                best, at = scores[k], i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Codec:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.ids = {p: i for i, p in enumerate(model.pieces) if model.kinds[i] == 1}
        self.length = [len(p) for p in model.pieces]
        self.automaton = ahocorasick.Automaton()
        for i in model.whole:
            self.automaton.add_word(model.pieces[i], (len(model.pieces[i]), i))
        self.automaton.make_automaton()
        known = {model.pieces[i]: i for i in model.whole}
        #: the longest token that is a proper prefix, or -1
        self.shorter = [-1] * len(model.pieces)
        for p, i in known.items():
            self.shorter[i] = next((known[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in known), -1)
        self.single = {p for p in known if len(p) == 1}
        byte_ids = {int(p[3:5], 16): i for i, p in enumerate(model.pieces) if model.kinds[i] == 6}
        self.bytes = [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None
        self.byte_of = {i: b for b, i in byte_ids.items()}
        self.unknown = model.kinds.index(2)
        self.plain_from = max(i for i, k in enumerate(model.kinds) if k != 1)  # ids above it are normal pieces
        cut = "" if any("\n" in p for p in known) else "\n"
        self.parts = re.compile(f"{SPACE}+[^{SPACE}{cut}]*|[^{SPACE}{cut}]+" + (f"|{cut}+" if cut else ""))
        self.pairs: dict[int, bool] = {}
        self.memory: dict[str, str] = {}  # part to its ids in decimal
        self.odd: dict[str, str] = {}  # part to what its ids decode to, where that isn't the part

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when their text is merged."""
        key = left << 20 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            a, b = self.model.pieces[left], self.model.pieces[right]
            found = self.pairs[key] = merge(a + b, self.ids, self.model.scores) == [a, b]
        return found

    def _known(self, text: str) -> list[int]:
        """Ids of a text whose characters are all pieces."""
        n = len(text)
        longest = [-1] * n
        for end, (size, i) in self.automaton.iter(text):
            longest[end - size + 1] = i
        length, shorter, pairs, fits = self.length, self.shorter, self.pairs, self.fits
        failed = 0 if n < 1000 else bytearray(n // 8 + 1)  # a bit for each position; short texts have it in one number
        found: list[int] = []
        at, token, left = 0, longest[0], -1
        while True:
            if token < 0:  # nothing fits from here: mark it and shorten the token before
                if n < 1000:
                    failed |= 1 << at
                else:
                    failed[at >> 3] |= 1 << (at & 7)
                last = found.pop()
                left = found[-1] if found else -1
                at -= length[last]
                token = shorter[last]
                continue
            after = at + length[token]
            if failed and (failed >> after & 1 if n < 1000 else failed[after >> 3] >> (after & 7) & 1):
                token = shorter[token]
                continue
            apart = True if left < 0 else pairs.get(left << 20 | token)
            if apart is None:
                apart = fits(left, token)
            if apart:
                found.append(token)
                if after == n:
                    return found
                left, at, token = token, after, longest[after]
            else:
                token = shorter[token]

    def encode_part(self, part: str) -> list[int]:
        single = self.single
        if single.issuperset(part):
            return self._known(part)
        out: list[int] = []
        begun = 0
        for i, c in enumerate(part):
            if c not in single:
                if begun < i:
                    out += self._known(part[begun:i])
                out += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
                begun = i + 1
        return out + self._known(part[begun:]) if begun < len(part) else out

    def _forget(self) -> None:
        if len(self.memory) >= REMEMBERED or len(self.odd) >= REMEMBERED:
            self.memory.clear()
            self.odd.clear()

    def encode(self, text: str, end: bool = True) -> list[int]:
        self._forget()
        out = [int(x) for p in self._split(text) for x in self._remembered(p).split(" ")]
        return [*out, self.model.end_id] if end else out

    def _split(self, text: str) -> list[str]:
        return self.parts.findall((SPACE if self.model.prefix and text else "") + text.replace(" ", SPACE))

    def _remembered(self, part: str) -> str:
        found = self.memory.get(part)
        if found is None:
            ids = self.encode_part(part)
            found = " ".join(map(str, ids))
            if (plain := self._plain(ids)) != part.replace(SPACE, " "):
                self.odd[part] = plain
            if len(part) <= LONG:
                self.memory[part] = found
        return found

    def _plain(self, ids: list[int]) -> str:
        """Decoded text with every space kept."""
        pieces, kinds = self.model.pieces, self.model.kinds
        if ids and min(ids) > self.plain_from:
            return "".join([pieces[i] for i in ids]).replace(SPACE, " ")
        out, raw = [], bytearray()
        for i in ids:
            kind = kinds[i]
            if kind == 6:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            if kind != 3:
                out.append(self.model.unknown_surface if kind == 2 else self.model.pieces[i].replace(SPACE, " "))
        return "".join(out) + (_utf8(raw) if raw else "")

    def decode(self, ids: list[int]) -> str:
        first = next((i for i in ids if self.model.kinds[i] != 3), None)
        plain = self._plain(ids)
        return plain if first is None or self.model.kinds[first] == 6 else self._unprefixed(plain)

    def _unprefixed(self, plain: str) -> str:
        return plain[1:] if self.model.prefix and plain[:1] == " " else plain

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded text."""
        self._forget()
        known, miss = self.memory.get, self._remembered
        parts = self._split(text or "")
        ids = " ".join([*[known(p) or miss(p) for p in parts], str(self.model.end_id)])
        plain = "".join([self.odd.get(p, p) for p in parts] if self.odd else parts).replace(SPACE, " ")
        return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(self._unprefixed(plain).encode()).hexdigest()


def _utf8(raw: bytearray) -> str:
    """Bytes as text, one replacement sign for each byte that begins no character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            size = next((n for n in (1, 2, 3, 4) if _is_character(raw[i : i + n], n)), 0)
            out.append(raw[i : i + size].decode() if size else "�")
            i += size or 1
        return "".join(out)


def _is_character(raw: bytearray, n: int) -> bool:
    try:
        return len(raw) == n and len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def _codec(key: str, shared) -> Codec:
    """A worker's own codec for a broadcast model."""
    codecs = memory("piece_codec")
    if key not in codecs:
        codecs[key] = Codec(shared.value)
    return codecs[key]


def _shared(spark: SparkSession, path: str):
    model = load(path)
    prepare(spark)
    return hashlib.sha256("\n".join(model.pieces).encode()).hexdigest(), spark.sparkContext.broadcast(model)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of documents (doc_id, text)."""
    key, shared = _shared(docs.sparkSession, path or default_path())

    @F.arrow_udf(T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
    def digests(texts: pa.Array) -> pa.Array:
        codec = _codec(key, shared)
        rows = [codec.digests(x.as_py()) for x in texts]
        n, ids, plain = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests("text").alias("x")).select("doc_id", "x.*")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with a column ids (array<int>), the end id included; a column of that name is replaced."""
    key, shared = _shared(docs.sparkSession, path or default_path())

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(texts: pa.Array) -> pa.Array:
        codec = _codec(key, shared)
        return pa.array([codec.encode(x.as_py() or "") for x in texts], pa.list_(pa.int32()))

    return docs.withColumn("ids", encoded("text"))


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with the column text replaced by what its ids decode to; null ids give the empty text."""
    key, shared = _shared(encoded.sparkSession, path or default_path())

    @F.arrow_udf(T.StringType())
    def decoded(ids: pa.Array) -> pa.Array:
        codec = _codec(key, shared)
        return pa.array([codec.decode(x.as_py() or []) for x in ids], pa.string())

    return encoded.withColumn("text", decoded("ids"))
