"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, and decoding.

A rank file (base64 of a token's bytes and its id on each line) becomes a BPE model over
characters: every byte maps to a printable character, and every split of a token into two tokens
is a merge of the token's rank, so the model joins any neighbours whose join has a rank, the least
rank first. Texts are divided by the tokenizer's pattern with vectorised tests of character
classes; each distinct piece of a batch is encoded once by the library and its ids are placed
wherever the piece stands. Each batch is decoded again and compared with its input, and a text
that differs is encoded piece by piece; so a collision of the hashes that group pieces can't show.

Decoding reverses the byte table. A character whose bytes are split over tokens, or over two calls,
is put together by ``decode_stream``; ``decode`` gives the bytes.

Defined results: a null text is an empty text, and an empty text has no tokens; control strings in
a text are ordinary text; repeated rows are encoded alike; other input columns stay.
"""

from __future__ import annotations

import base64
import codecs
import os
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm.bytescan import Texts, pieces, spread
from siftwork.llm.common import table

LETTER, NUMBER, OTHER, SPACE, END = range(5)

#: White space as in Unicode's White_Space property.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Bytes of text that are encoded at once: bounds a worker's memory, of which a task has two here.
PIECE_BYTES = 400_000

#: Pieces of text are kept with their ids up to this number in a worker, then forgotten.
_KEPT_PIECES = 500_000


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def byte_characters() -> dict[int, str]:
    """A printable character for each byte: itself where it is one in Latin-1, else one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[_SPACES] = SPACE
    return out


class Vocabulary:
    """The library's model for a rank file, its tokens' bytes by id, and pieces encoded so far."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.by_byte = byte_characters()
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = np.frombuffer(b"".join(tokens), np.uint8)
        lengths = np.array([len(t) for t in tokens])
        self.token_ends = np.cumsum(lengths)
        self.token_starts = self.token_ends - lengths
        self._model = None
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts = self.ends = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    @property
    def model(self):
        """The library's model; decoding never builds it."""
        if self._model is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
            from tokenizers import models

            tokens = [self.tokens[a:b].tobytes() for a, b in zip(self.token_starts, self.token_ends, strict=True)]
            named = {token: token.decode("latin-1").translate(self.by_byte) for token in tokens if token}
            merges = [(named[t[:i]], named[t[i:]]) for t in tokens for i in range(1, len(t)) if t[:i] in named and t[i:] in named]
            self._model = models.BPE(vocab={named[t]: r for r, t in enumerate(tokens) if t}, merges=merges, ignore_merges=True)
        return self._model

    def ids(self, piece: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.by_byte))]

    def places(self, hashes: np.ndarray, spell: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``flat`` the ids of pieces lie, given their distinct hashes in order; ``spell`` gives the bytes of the i-th."""
        if len(self.hashes) > _KEPT_PIECES:
            self._forget()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[at] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(new):
            found = [self.ids(spell(i)) for i in new]
            ends = np.cumsum([len(x) for x in found]) + len(self.flat)
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32)])
            every = np.concatenate([self.hashes, hashes[new]])
            order = np.argsort(every, kind="stable")
            self.starts = np.concatenate([self.starts, ends - [len(x) for x in found]])[order]
            self.ends = np.concatenate([self.ends, ends])[order]
            self.hashes = every[order]
            at = np.searchsorted(self.hashes, hashes)
        return self.starts[at], self.ends[at]

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the ids end to end, end of each id's bytes)."""
        starts, ends = self.token_starts[ids], self.token_ends[ids]
        return self.tokens[spread(starts, ends)[0]], np.cumsum(ends - starts)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def piece_spans(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the pattern's matches in all texts, in order."""
    raw = texts.bytes.tobytes()
    points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(wide, out=at[1:])
    kind = _classes()[points]
    ends = np.searchsorted(at, texts.ends)
    kind[ends] = END
    first = np.ones(len(kind), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == END)
    # of white space before anything else the last character stands alone, or with what follows if it is a blank
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END))
    first[last] = True
    blank = last[points[last] == 0x20]
    first[blank + 1] = False
    # contractions: a single quote that starts a piece, and the letters after it
    n = len(points)
    quote = np.flatnonzero((points == 0x27) & first & (kind == OTHER))
    quote = quote[(quote + 1 < n) & (kind[np.minimum(quote + 1, n - 1)] == LETTER)]
    if len(quote):
        one, two = points[quote + 1], np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
        s, t, r, e, v, m, d, ll = (ord(c) for c in "strevmdl")
        long_ = ((one == r) & (two == e)) | ((one == v) & (two == e)) | ((one == ll) & (two == ll))
        short = (one == s) | (one == t) | (one == m) | (one == d)
        size = np.where(long_, 2, np.where(short, 1, 0))
        quote, size = quote[size > 0], size[size > 0]
        first[quote + 1] = False
        first[quote + 1 + size] = True
    start = np.flatnonzero(first)
    stop = np.append(start[1:], n)
    real = kind[start] != END
    return at[start[real]], at[stop[real]]


_PATTERN = None


def _slow_spans(text: bytes) -> list[bytes]:
    global _PATTERN
    if _PATTERN is None:
        import public_tokenizers
        import regex

        _PATTERN = regex.compile(public_tokenizers.PATTERN)
    return [m.encode() for m in _PATTERN.findall(text.decode("utf-8", "replace"))]


def encode_texts(column: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, Texts]:
    """(ids of all texts end to end, bounds of the texts, the texts)."""
    texts = Texts(column)
    starts, ends = piece_spans(texts)
    hashes = texts.hash_spans(starts, ends)
    distinct, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
    lo, hi = vocab.places(distinct, lambda i: texts.bytes[starts[sample[i]] : ends[sample[i]]].tobytes())
    ids = vocab.flat[spread(lo[which], hi[which])[0]]
    upto = np.zeros(len(starts) + 1, np.int64)
    np.cumsum((hi - lo)[which], out=upto[1:])
    bounds = upto[np.searchsorted(starts, np.append(texts.starts, len(texts.bytes)))]
    back, _ = vocab.bytes_of(ids)
    whole = np.ones(len(texts.bytes), bool)
    whole[texts.ends] = False
    if not np.array_equal(back, texts.bytes[whole]):
        each = [np.array([i for p in _slow_spans(texts.bytes[a:b].tobytes()) for i in vocab.ids(p)], np.int32) for a, b in zip(texts.starts, texts.ends, strict=True)]
        ids = np.concatenate(each) if each else ids
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    return ids, bounds, texts


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, path: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """``docs`` without ``text``, and n_tokens, ids, n_split_chars (characters whose bytes lie in several tokens).

    With ``offsets`` also starts, the character with which each token begins, counted from 0.
    """
    others = [c for c in docs.columns if c not in (text, "n_tokens", "ids", "n_split_chars", "starts")]
    kind = T.StructType([docs.schema[c] for c in others]).add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType())).add("n_split_chars", "long")
    if offsets:
        kind = kind.add("starts", T.ArrayType(T.IntegerType()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for part in pieces(batch, text, PIECE_BYTES):
                ids, bounds, texts = encode_texts(part.column(text), vocab)
                _, stop = vocab.bytes_of(ids)
                size = texts.ends - texts.starts
                base = np.cumsum(size) - size
                begin = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
                plain = np.ones(len(texts.bytes), bool)
                plain[texts.ends] = False
                body = texts.bytes[plain]
                lead = np.zeros(len(body) + 1, np.int64)
                np.cumsum((body & 0xC0) != 0x80, out=lead[1:])
                inside = begin[(body[np.minimum(begin, max(len(body) - 1, 0))] & 0xC0) == 0x80] if len(body) else begin[:0]
                split = np.unique(lead[inside])  # several boundaries may fall in one character
                owner = np.searchsorted(lead[base], split - 1, "right") - 1 if len(split) else split
                n_split = np.bincount(owner, minlength=texts.n) if len(split) else np.zeros(texts.n, np.int64)
                columns = [part.column(c) for c in others] + [pa.array(np.diff(bounds)), _lists(ids, bounds), pa.array(n_split.astype(np.int64))]
                if offsets:
                    own = np.repeat(lead[base], np.diff(bounds))
                    columns.append(_lists(lead[begin + 1] - 1 - own if len(begin) else begin, bounds))
                yield pa.RecordBatch.from_arrays(columns, names=kind.names)

    return docs.select(*others, F.coalesce(F.col(text), F.lit("")).alias(text)).mapInArrow(scan, kind)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with decoded, the bytes of each row's ids. Null ids and ids without a token have no bytes."""
    kind = T.StructType([f for f in encoded.schema if f.name != "decoded"]).add("decoded", T.BinaryType())
    names = [c for c in encoded.columns if c != "decoded"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                column = part.column(ids)
                flat = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                size = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                known = (flat >= 0) & (flat < len(vocab.token_ends))
                if not known.all():
                    row = np.repeat(np.arange(len(size)), size)[known]
                    flat, size = flat[known], np.bincount(row, minlength=len(size))
                body, stop = vocab.bytes_of(flat)
                upto = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(size)])]
                out = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(upto.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), out], names=kind.names)

    return encoded.select(*names).mapInArrow(scan, kind)


def decode_stream(chunks: Iterable[list[int]], path: str) -> Iterator[str]:
    """The text of chunks of ids; a character split between chunks comes with the chunk that ends it."""
    vocab, part = vocabulary(path), codecs.getincrementaldecoder("utf-8")("replace")
    for chunk in chunks:
        yield part.decode(vocab.bytes_of(np.array(chunk, np.int64))[0].tobytes())
    yield part.decode(b"", True)


def digests(decoded: DataFrame) -> DataFrame:
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return decoded.select("doc_id", "n_tokens", ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_split_chars")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = vocabulary_path()
    return digests(decode(encode(docs, path), path))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: token counts and digests of the mix."""
    path = vocabulary_path()
    return digests(decode(encode(docs.select("doc_id", "text"), path), path))
