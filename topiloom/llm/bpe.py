"""Byte-pair encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 32 bytes cuts each text at places that depend on the bytes
alone, so documents that share passages share chunks. A chunk's inner part, from its first
to its last safe place, is encoded once in a task and then looked up; a safe place is a
single space between two characters that are no white space, where the tokenizer always
starts a new piece. The rest, around each cut, is the join: it is encoded anew, from the
last safe place before the cut to the first one after it. If a chunk has no safe place the
join grows over it until it reaches one, so the pieces always agree with an encoding of the
whole text.

The chunk store of a task is bounded by ``STORE_BYTES``; when it is full it starts anew.
Copies of long texts are met in many tasks and encoded once in each; sharing them between
tasks would shuffle all text. Null texts are empty texts and have no tokens.

Texts of plain Latin, Greek and Cyrillic letters go through the ``tiktoken`` form of the
vocabulary, which is several times faster; pieces with any other character, where character
classes may differ between the two libraries, go through the ``tokenizers`` file itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .flat import _CODES, column, tidied
from .tables import keep_rest, modest_batches

#: On average a cut every 1,024 bytes.
CUT_MASK = np.uint32((1 << 10) - 1 << 22)
STORE_BYTES = 24 << 20
_GEAR = (_CODES >> np.uint64(31)).astype(np.uint32)
_WHITE = re.compile(r"\s")
_SAFE = re.compile(rb"(?<=[!-~]) (?=[!-~])")
_OTHER = re.compile("[^\\x00-\\u024f\\u0370-\\u0373\\u0386-\\u03ce\\u0400-\\u045f\\u2010-\\u2027\\u20ac]")


class Codec:
    """One tokenizer: piece encoder, bytes of each token, and its text form in digits."""

    def __init__(self, json_file: str, ranks_file: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_file)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.fast = None
        if ranks_file:
            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.special = set(special)
        n = self.slow.get_vocab_size()
        self.digits = [str(i) for i in range(n)]

    def encode(self, piece: str) -> list[int]:
        if self.fast is not None and not _OTHER.search(piece):
            return self.fast.encode(piece, allowed_special=self.special, disallowed_special=())
        return self.slow.encode(piece, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the text that the ids stand for."""
        if self.fast is not None:
            return self.fast.decode_bytes(ids)
        return self.slow.decode(ids, skip_special_tokens=False).encode()


@lru_cache(maxsize=2)
def codec(json_file: str, ranks_file: str | None) -> Codec:
    return Codec(json_file, ranks_file)


def cuts(data: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last 32 bytes asks for a cut."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        step = h.copy()
        step[k:] += h[:-k] << np.uint32(k)
        h = step
    return np.flatnonzero((h & CUT_MASK) == 0) + 1


def pieces(raw: bytes) -> Iterator[tuple[bool, bytes]]:
    """A text as inner parts of chunks (True) and joins (False), in order."""
    if not raw:
        return
    at = [int(x) for x in cuts(np.frombuffer(raw, np.uint8)) if x < len(raw)] if len(raw) > 32 else []
    done = 0
    for lo, hi in zip([0, *at], [*at, len(raw)]):
        first = _SAFE.search(raw, max(lo, done), hi) if lo else None
        start = lo if not lo else first.start() if first else None
        if start is None:
            continue
        if hi == len(raw):
            end = hi
        else:
            end = raw.rfind(b" ", start + 1, hi)
            while end > start and not _SAFE.match(raw, end):
                end = raw.rfind(b" ", start + 1, end)
            if end <= start:
                continue
        if start > done:
            yield False, raw[done:start]
        yield True, raw[start:end]
        done = end
    if done < len(raw):
        yield False, raw[done:]


class Encoder:
    """Encodes texts piece by piece and remembers the pieces."""

    def __init__(self, c: Codec):
        self.codec, self.store, self.held, self.reused, self.fresh = c, {}, 0, 0, 0

    def piece(self, raw: bytes) -> tuple[int, bytes, bytes, bytes]:
        """Number of tokens, ids as digits and as 16- or 32-bit integers, decoded bytes."""
        key = hashlib.blake2b(raw, digest_size=16).digest() if len(raw) > 48 else raw
        got = self.store.get(key)
        if got is not None:
            self.reused += len(raw)
            return got
        self.fresh += len(raw)
        ids = self.codec.encode(raw.decode())
        digits = self.codec.digits
        got = len(ids), ",".join([digits[i] for i in ids]).encode(), np.array(ids, np.uint32).tobytes(), self.codec.decode(ids)
        self.held += 300 + 2 * len(raw) + len(got[1]) + len(got[2])
        if self.held > STORE_BYTES:
            self.store.clear()
            self.held = 0
        self.store[key] = got
        return got

    def text(self, raw: bytes) -> list[tuple[int, bytes, bytes, bytes]]:
        return [self.piece(p) for _, p in pieces(raw)]


def _encode(batches: Iterator[pa.RecordBatch], files: tuple[str, str | None], with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = Encoder(codec(*files))
    for batch in batches:
        n, shas, backs, ids = [], [], [], []
        for x in column(batch, "text").cast(pa.binary()):
            parts = enc.text(x.as_py() or b"")
            n.append(sum(p[0] for p in parts))
            shas.append(hashlib.sha256(b",".join([p[1] for p in parts])).hexdigest())
            # pieces are cut between characters, so decoding them apart is decoding the whole
            back = b"".join([p[3] for p in parts]).decode("utf-8", "replace")
            backs.append(hashlib.sha256(back.encode()).hexdigest())
            if with_ids:
                ids.append(np.frombuffer(b"".join([p[2] for p in parts]), np.uint32).astype(np.int32))
        rest = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"}
        out = rest | {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": shas, "decoded_sha256": backs}
        if with_ids:
            out["input_ids"] = pa.array(ids, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_pydict(out)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, json_file: str | None = None, ranks_file: str | None = None, with_ids: bool = False) -> DataFrame:
    """Token counts and digests of every text, and the ids themselves with ``with_ids``.

    Columns of the input other than ``text`` pass through; those named like an output give
    way to it. ``json_file`` is a file of the tokenizers library and ``ranks_file`` the same
    vocabulary as ranks, or None; both must be at the same place on every executor.
    """
    files = (json_file, ranks_file) if json_file else default_files()
    docs = modest_batches(docs).select(keep_rest(docs, "n_tokens", "ids_sha256", "decoded_sha256", "input_ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    schema += (", " if schema else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", input_ids array<int>" * with_ids
    return docs.mapInArrow(lambda it: tidied(_encode(it, files, with_ids)), schema)


def decode(encoded: DataFrame, json_file: str | None = None, ranks_file: str | None = None, ids: str = "input_ids") -> DataFrame:
    """Texts from arrays of ids, as ``text``; a null array is an empty text."""
    files = (json_file, ranks_file) if json_file else default_files()
    encoded = modest_batches(encoded).select(keep_rest(encoded, "text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != ids)

    def run(batches):
        c = codec(*files)
        for batch in batches:
            texts = [c.decode(x or []).decode("utf-8", "replace") for x in column(batch, ids).to_pylist()]
            rest = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != ids}
            yield pa.RecordBatch.from_pydict(rest | {"text": pa.array(texts, pa.string())})

    return encoded.mapInArrow(run, schema + (", " if schema else "") + "text string")


def op5_bpe(spark, sf_dir):
    """Whole ``documents`` encoded and decoded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
