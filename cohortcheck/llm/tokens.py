"""Token counts that follow edits: a segment tree of pre-token runs per document."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from cohortcheck.llm.bpe import PATTERN, tokenizer_path
from cohortcheck.llm.common import importable, read_table

# A leaf takes whole pre-tokens until it has this many characters.
LEAF_CHARS = 512
# A single blank between two other characters starts a pre-token, whatever stands around it.
_CUT = re.compile(r"(?<=\S) (?=\S)")

# Optional input columns, and what their types must name.
STATE = {"edits": ("array<struct<", "start:", "stop:", "text:"), "leaves": ("array<struct<", "chars:", "tokens:")}

Edit = tuple[int, int, str]


def leaves_of(text: str, size: int = LEAF_CHARS) -> list[str]:
    """``text`` in runs of whole pre-tokens of about ``size`` characters; a run without a safe cut stays whole."""
    cuts, at = [0], size
    while at < len(text):
        cut = _CUT.search(text, at - 1)
        if cut is None:
            break
        cuts.append(cut.start())
        at = cut.start() + size
    cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


def _joins(left: str, right: str) -> bool:
    """May the texts be counted apart? ``right`` has at least its first two characters, ``left`` its last one."""
    return not left or not right or (len(right) > 1 and right[0] == " " and not (right[1].isspace() or left[-1].isspace()))


class CountTree:
    """Characters and tokens of a document's leaves, with sums over subtrees.

    An edit costs the leaves that it touches, plus neighbours while the seam to them is no safe cut, plus the paths from those
    leaves to the root.
    """

    def __init__(self, leaves: list[str], count: Callable[[str], int], tokens: list[int] | None = None):
        self.count = count
        self.encoded = 0
        self._build(leaves, tokens if tokens is not None else [self._encode(leaf) for leaf in leaves])

    def _encode(self, leaf: str) -> int:
        self.encoded += 1
        return self.count(leaf)

    def _build(self, leaves: list[str], tokens: list[int]) -> None:
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.leaves = leaves + [""] * (self.size - len(leaves))
        self.chars = [0] * self.size + [len(x) for x in self.leaves]
        self.tokens = [0] * self.size + tokens + [0] * (self.size - len(tokens))
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def filled(self) -> list[int]:
        return [i for i, leaf in enumerate(self.leaves) if leaf]

    def find(self, at: int) -> tuple[int, int]:
        """Leaf that holds the character ``at`` (the last filled one at the end), and where the leaf starts."""
        node, start = 1, 0
        at = min(at, max(0, self.n_chars - 1))
        while node < self.size:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def _beside(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < self.size and not self.leaves[leaf]:
            leaf += step
        return leaf if 0 <= leaf < self.size else None

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        node = leaf + self.size
        self.leaves[leaf], self.chars[node], self.tokens[node] = text, len(text), tokens
        while node > 1:
            node //= 2
            self._sum(node)

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters from ``start`` up to ``end`` of the present text; ends are clipped to it."""
        start = min(max(0, start), self.n_chars)
        end = min(max(start, end), self.n_chars)
        low, at = self.find(start)
        high, _ = self.find(max(start, end - 1))
        region = "".join(self.leaves[low : high + 1])
        region = region[: start - at] + replacement + region[end - at :]
        while (before := self._beside(low, -1)) is not None and not _joins(self.leaves[before], region[:2]):
            low, region = before, self.leaves[before] + region
        while (after := self._beside(high, 1)) is not None and not _joins(region, self.leaves[after][:2]):
            high, region = after, region + self.leaves[after]
        pieces = leaves_of(region)
        counts = [self._encode(p) for p in pieces]
        if len(pieces) > high - low + 1:
            old = [(x, t) for x, t in zip(self.leaves, self.tokens[self.size :])]
            new = old[:low] + list(zip(pieces, counts)) + old[high + 1 :]
            new = [(x, t) for x, t in new if x]
            self._build([x for x, _ in new], [t for _, t in new])
            return
        for i in range(low, high + 1):
            piece = i - low
            self._put(i, *((pieces[piece], counts[piece]) if piece < len(pieces) else ("", 0)))


_encoders: dict[int, tiktoken.Encoding] = {}


def _encoder(ranks: Broadcast) -> tiktoken.Encoding:
    key = hash(ranks.value)
    if key not in _encoders:
        pairs = (line.split() for line in ranks.value.splitlines() if line)
        table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


# What a pipeline masks before training: addresses, numbers of phones and accounts, hosts by number.
MASKS = [
    (re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "[EMAIL]"),
    (re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), "[IP]"),
    (re.compile(r"\+\d{1,3} ?\(\d{2,4}\) ?\d{3}-\d{4}"), "[PHONE]"),
    (re.compile(r"\b\d{9,}\b"), "[NUMBER]"),
]


def masking_edits(text: str) -> list[Edit]:
    """Edits that mask personal data, the last first, so that earlier positions stay right."""
    found: list[Edit] = []
    for pattern, mask in MASKS:
        found += [(m.start(), m.end(), mask) for m in pattern.finditer(text)]
    found.sort()
    kept: list[Edit] = []
    for edit in found:
        if not kept or edit[0] >= kept[-1][1]:
            kept.append(edit)
    return kept[::-1]


def count_edits(
    docs: DataFrame, path: str, editor: Callable[[str], list[Edit]] | None = None, with_state: bool = False
) -> DataFrame:
    """Tokens of every text before and after its edits.

    ``docs`` has ``doc_id``, ``text`` and, without an ``editor``, ``edits array<struct<start,stop,text>>``, applied in their
    order to the text as it is then. A column ``leaves array<struct<chars,tokens>>`` from an earlier run saves counting
    the unchanged text again. Returns ``doc_id, n_tokens, n_tokens_edited, n_edits, n_leaves, n_encoded``
    (leaves encoded for the edits) and, ``with_state``, the edited ``text`` and its ``leaves``. A null text counts
    as empty. Null edits count as none, and so does an edit without a start or a stop; an edit without a text deletes. Leaves
    that hold a null, or that are not as long as the text, are made anew. Columns called ``edits`` or ``leaves``
    of another type are ignored; null ids, repeated rows and further columns are allowed. No shuffle: a document's
    tree lives in its own row.
    """
    spark = docs.sparkSession
    importable(spark)
    with open(path, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())
    types = dict(docs.dtypes)
    names = ["doc_id", "text"]
    names += [c for c, fields in STATE.items() if all(f in types.get(c, "") for f in fields) and not (c == "edits" and editor)]
    state = ", text string, leaves array<struct<chars:int,tokens:int>>" if with_state else ""
    kind = types["doc_id"]
    columns = ["n_tokens", "n_tokens_edited", "n_edits", "n_leaves", "n_encoded"]
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in columns) + state

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks).encode_ordinary
        for batch in batches:
            out: list[list] = [[] for _ in columns]
            texts, kept = [], []
            edits = batch.column("edits").to_pylist() if "edits" in names else None
            leaves = batch.column("leaves").to_pylist() if "leaves" in names else None
            for i, text in enumerate(batch.column("text").to_pylist()):
                tree = _tree(text or "", leaves[i] if leaves else None, lambda leaf: len(encode(leaf)))
                before, tree.encoded = tree.n_tokens, 0
                todo = editor(text or "") if editor else given_edits(edits[i]) if edits else []
                for edit in todo:
                    tree.edit(*edit)
                filled = tree.filled()
                for column, value in zip(out, (before, tree.n_tokens, len(todo), len(filled), tree.encoded)):
                    column.append(value)
                if with_state:
                    texts.append(tree.text)
                    kept.append([{"chars": tree.chars[tree.size + j], "tokens": tree.tokens[tree.size + j]} for j in filled])
            arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out)]
            if with_state:
                leaf = pa.struct([("chars", pa.int32()), ("tokens", pa.int32())])
                arrays += [pa.array(texts, pa.string()), pa.array(kept, pa.list_(leaf))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *columns, *(["text", "leaves"] if with_state else [])])

    return docs.select(*names).mapInArrow(work, schema)


def given_edits(edits: list[dict | None] | None) -> list[Edit]:
    """The edits of a row, without those that are null or have no start or stop."""
    whole = (e for e in edits or [] if e and e["start"] is not None and e["stop"] is not None)
    return [(e["start"], e["stop"], e["text"] or "") for e in whole]


def _usable(leaves: list[dict | None] | None, text: str) -> bool:
    if leaves is None or any(x is None or None in (x["chars"], x["tokens"]) for x in leaves):
        return False
    return all(x["chars"] > 0 for x in leaves) and sum(x["chars"] for x in leaves) == len(text)


def _tree(text: str, leaves: list[dict | None] | None, count: Callable[[str], int]) -> CountTree:
    if not _usable(leaves, text):
        return CountTree(leaves_of(text), count)
    at, parts = 0, []
    for leaf in leaves:
        parts.append(text[at : at + leaf["chars"]])
        at += leaf["chars"]
    return CountTree(parts, count, [x["tokens"] for x in leaves])


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after personal data are masked."""
    docs = read_table(spark, sf_dir, "documents")
    return count_edits(docs, tokenizer_path("byte_bpe_50k.tiktoken"), masking_edits)
