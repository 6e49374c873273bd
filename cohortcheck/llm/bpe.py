"""Byte-level BPE encoding with forced-boundary splitting, and decoding."""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from cohortcheck.llm.common import importable, read_table

# Fixed value: the public pattern by which byte-level BPE parts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pieces of text that a worker remembers; its memory for them stays below about 150 MB.
REMEMBERED = 500_000


def _byte_of() -> dict[str, int]:
    """The public alphabet of byte-level BPE: printable bytes stand for themselves, the others move up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Codec:
    """Encoder and decoder of one tokenizer file (its JSON text)."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        made = [ranks[bytes(byte_of[c] for c in a + b)] for a, b in merges]
        if made != sorted(made):
            raise ValueError("the order of the merges is not that of the ids")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # Longer tokens first, as in a leftmost-longest search.
        names = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.pieces = regex.compile(PATTERN).findall
        self.inside = {token[i : i + 2] for token in ranks for i in range(len(token) - 1)}
        # Merging alone: the pattern takes a fragment as it is.
        self.merge = tiktoken.Encoding("fragments", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of = {i: token for token, i in ranks.items()} | {i: t.encode() for t, i in self.added.items()}
        self.known: dict[str, bytes] = {}

    def fragments(self, piece: str) -> Iterator[str]:
        """``piece`` cut between characters whose adjoining bytes stand side by side in no token.

        No merge can bridge such a cut, so fragments may be encoded on their own.
        """
        start = 0
        for i in range(1, len(piece)):
            left, right = piece[i - 1].encode("utf-8")[-1:], piece[i].encode("utf-8")[:1]
            if left + right not in self.inside:
                yield piece[start:i]
                start = i
        if piece:
            yield piece[start:]

    def _learn(self, piece: str) -> bytes:
        ids = array("I")
        for fragment in self.fragments(piece):
            ids.extend(self.merge(fragment))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        # Very long pieces do not come again.
        if len(piece) <= 64:
            self.known[piece] = ids.tobytes()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit numbers, low byte first on every usual machine.

        The pattern needs the text around a piece (white space before a word), so pieces are found in the whole
        text first; forced boundaries then cut the pieces.
        """
        parts = self.special.split(text) if self.special else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(array("I", [self.added[part]]).tobytes())
                continue
            known = self.known
            for piece in self.pieces(part):
                out.append(known.get(piece) or self._learn(piece))
        return b"".join(out)

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ``ids``; bytes that form no character show as the replacement mark."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def _codec(spec: Broadcast) -> Codec:
    """One codec per worker process and tokenizer."""
    key = hash(spec.value)
    if key not in _codecs:
        _codecs[key] = Codec(spec.value)
    return _codecs[key]


def _numbers(packed: bytes) -> array:
    ids = array("I")
    ids.frombytes(packed)
    return ids


def _little(packed: bytes) -> bytes:
    if sys.byteorder == "little":
        return packed
    ids = _numbers(packed)
    ids.byteswap()
    return ids.tobytes()


def _send(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file, read by the driver: a vocabulary of fixed size, not data."""
    importable(spark)
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _over(docs: DataFrame, column: str, schema: str, rows: Callable[[list], list[pa.Array]], names: list[str]) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = rows(batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", *names])

    return docs.select("doc_id", column).mapInArrow(work, f"doc_id {kind}, {schema}")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` for every row of ``docs(doc_id, text)``.

    A null text counts as empty and has no ids. Null ids, repeated rows and further columns are allowed. No shuffle; a task
    holds one Arrow batch (bounded in bytes by the session) and a bounded memory of pieces.
    """
    spec = _send(docs.sparkSession, path)

    def rows(texts: list) -> list[pa.Array]:
        codec = _codec(spec)
        return [pa.array([_numbers(codec.encode(t or "")) for t in texts], pa.list_(pa.int32()))]

    return _over(docs, "text", "ids array<int>", rows, ["ids"])


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` for every row of ``coded(doc_id, ids)``; null ids give an empty text."""
    spec = _send(coded.sparkSession, path)

    def rows(lists: list) -> list[pa.Array]:
        codec = _codec(spec)
        return [pa.array([codec.decode(ids or []) for ids in lists], pa.string())]

    return _over(coded, "ids", "text string", rows, ["text"])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: ids of each text, and the text decoded from them.

    Does the work of :func:`encode` and :func:`decode` in one pass, without sending the ids through Spark.
    """
    spec = _send(docs.sparkSession, path)

    def rows(texts: list) -> list[pa.Array]:
        codec = _codec(spec)
        n, ids_sha, text_sha = [], [], []
        for text in texts:
            packed = codec.encode(text or "")
            ids = _numbers(packed)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(_little(packed)).hexdigest())
            text_sha.append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return _over(docs, "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", rows, names)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())
