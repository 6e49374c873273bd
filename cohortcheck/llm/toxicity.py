"""Toxicity by the nearest labelled examples under TF-IDF cosine, found in an index of their terms."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcheck.llm.common import checkpointed, importable, join_checked, read_table

# Labelled rows that the classifier keeps as examples at most, taken by a hash of their ids.
MAX_EXAMPLES = 20_000
# Examples without a lean that a term's share of toxic examples is shrunken by, and the power of what it then tells.
LEAN_ROWS = 5.0
LEAN_POWER = 2.0
NEIGHBOURS = 15
BLOCK = 64
# Examples of one kind and like length that share a matrix, at most; its columns are the terms of more than one in so many of
# them, at most ``DENSE``. Texts that are scored at once, and texts that these are put together from.
ROWS = 2048
DENSE_SHARE = 12
DENSE = 2048
TEXTS = 256
WINDOW = 2048
# Postings up to which those of a text's terms are fetched one by one, not as a whole.
FEW = 128
# Kinds of examples are told apart by so many of the most frequent terms, from so many examples at first; those more alike than
# this cosine are one kind, and none has fewer than so many examples.
KIND_TERMS = 256
KIND_SEEDS = 32
KIND_COSINE = 0.5
KIND_ROWS = 512
BINS = 20
# Weight of the share of toxic examples among the votes.
PRIOR_VOTES = 0.5

_WORD = re.compile(r"\w+").findall
_BLANK = bytes(c if chr(c).isalnum() or c == 95 else 32 for c in range(256))
_ZSTD = pa.Codec("zstd", compression_level=1)


# Lengths of the beginnings of a word that are terms too, and words whose terms a process remembers.
_BEGINNINGS = (4, 5, 6)
WORDS = 300_000


def _features(word: str) -> list[str]:
    """A word and its beginnings, by which related forms meet."""
    return [word, *(f"{word[:n]}-" for n in _BEGINNINGS if len(word) > n)]


def _words(text: str | None) -> list[str]:
    """All ``\\w+`` of the lower-cased text; texts in Latin-1 need no pattern."""
    text = (text or "").lower()
    try:
        return text.encode("latin-1").translate(_BLANK).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD(text)


class Features(dict):
    """Words met so far, each with its features."""

    def __missing__(self, word: str) -> list[str]:
        self[word] = found = _features(word)
        return found


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def _term_counts(train: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """All terms of the examples, in order, and how far each tells their labels apart; none without both labels.

    The latter is the log-odds of a toxic label given the term against those of any example, from a share shrunken by
    ``LEAN_ROWS``: zero for a term that leans to no label.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, features = (Counter(), Counter()), Features()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts[toxic].update(set(chain.from_iterable(map(features.__getitem__, set(_words(text))))))
                if len(features) > WORDS:
                    features.clear()
            terms = list({**counts[0], **counts[1]})
            arrays = [pa.array(terms, pa.string()), *(pa.array([c.get(t, 0) for t in terms], pa.int64()) for c in counts[::-1])]
            yield pa.RecordBatch.from_arrays(arrays, ["term", "toxic", "other"])

    found = train.select("text", "toxic").mapInArrow(work, "term string, toxic long, other long")
    found = found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).orderBy("term")
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    a, b = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not a or not b:
        return pa.array([], pa.string()), np.zeros(0)
    table = found.toArrow()
    toxic, other = (table.column(c).to_numpy().astype(np.float64) for c in ("toxic", "other"))
    prior = a / (a + b)
    share = (toxic + LEAN_ROWS * prior) / (toxic + other + LEAN_ROWS)
    return table.column("term").combine_chunks(), np.abs(np.log(share / (1 - share)) - math.log(prior / (1 - prior)))


def _pack(terms: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending terms and their counts in few bytes: steps and counts, the bytes of equal weight side by side."""
    n = len(terms)
    if not n:
        return b""
    both = np.empty(2 * n, "<i4")
    both[0], both[n:] = terms[0], counts
    np.subtract(terms[1:], terms[:-1], out=both[1:n], casting="same_kind")
    return n.to_bytes(4, "little") + _ZSTD.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not packed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = int.from_bytes(packed[:4], "little")
    planes = np.frombuffer(_ZSTD.decompress(packed[4:], 8 * n, asbytes=True), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64)
    return both[:n].cumsum(), both[n:]


class Terms:
    """Numbers of the terms; the dictionary is made where it is used, once per process."""

    def __init__(self, names: pa.Array):
        self.names = names

    @cached_property
    def number(self) -> dict[str, int]:
        return {term: i for i, term in enumerate(self.names.to_pylist())}

    @cached_property
    def known(self) -> Known:
        return Known(self.number)


class Known(dict):
    """Words met so far, each with its row of ``numbers``: those of its terms, -1 where there is none."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number
        self.numbers = np.full((1024, 1 + len(_BEGINNINGS)), -1, np.int32)
        self.new: list[int] = []
        # Numbers of the beginnings of longer words, by the longest of them.
        self.begun: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        number, size, longest = self.number.get, len(word), word[: _BEGINNINGS[-1]]
        found = self.begun.get(longest) if size > _BEGINNINGS[-1] else None
        if found is None:
            found = tuple([number(f"{word[:n]}-", -1) if size > n else -1 for n in _BEGINNINGS])
            if size > _BEGINNINGS[-1]:
                self.begun[longest] = found
        self.new.append(number(word, -1))
        self.new += found
        return row

    def _write(self) -> None:
        """Fill the rows of the words that were added."""
        new = np.array(self.new, np.int32).reshape(-1, self.numbers.shape[1])
        self.new = []
        while len(self) > len(self.numbers):
            self.numbers = np.concatenate((self.numbers, np.full_like(self.numbers, -1)))
        self.numbers[len(self) - len(new) : len(self)] = new

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text in order, and how often each is met."""
        if len(self) > WORDS:
            self.clear()
            self.begun.clear()
        words = _words(text)
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self._write()
        terms = self.numbers[rows].ravel()
        terms = np.sort(terms[terms >= 0])
        if not len(terms):
            return terms, terms
        last = np.append(np.flatnonzero(terms[1:] != terms[:-1]), len(terms) - 1)
        counts = last + 1
        counts[1:] -= counts[:-1].copy()
        return terms[last], counts


def _vectors(docs: DataFrame, terms: Broadcast) -> DataFrame:
    """``doc_id, terms``: the terms of each whole text that the examples know, with their counts, packed."""
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value.known
        for batch in batches:
            packed = [_pack(*known.counted(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "terms"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, terms binary")


def _frequencies(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """Number of texts that hold each term."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_terms, np.int64)
        for batch in batches:
            for packed in batch.column("terms").to_pylist():
                seen[_unpack(packed)[0]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["t", "n"])

    table = vectors.select("terms").mapInArrow(work, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[table.column("t").to_numpy()] = table.column("n").to_numpy()
    return out


def _kinds(terms: list[np.ndarray], weights: list[np.ndarray], n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Examples by the frequent terms that they share, as those of one language do.

    Gives the kind of each example, a column or -1 for each term, and the centres of the kinds by column. Kinds only say which
    examples and texts are worked on together; results do not depend on them.
    """
    known = np.bincount(np.concatenate([np.zeros(0, np.int32), *terms]), minlength=n_terms)
    frequent = np.argsort(-known, kind="stable")[:KIND_TERMS]
    column = np.full(n_terms, -1, np.int32)
    column[frequent] = np.arange(len(frequent))
    rows = np.zeros((len(terms), len(frequent)), np.float32)
    for i, (t, w) in enumerate(zip(terms, weights)):
        at = column[t]
        rows[i, at[at >= 0]] = w[at >= 0]
    if not len(rows):
        return np.zeros(0, np.int64), column, np.zeros((1, len(frequent)), np.float32)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    centres = unit(rows[np.linspace(0, len(rows) - 1, min(KIND_SEEDS, len(rows))).astype(int)])
    for _ in range(6):
        kind = (rows @ centres.T).argmax(axis=1)
        sums = np.stack([rows[kind == j].sum(axis=0) for j in range(len(centres))])
        sums = sums[np.bincount(kind, minlength=len(centres)) > 0]
        centres = unit(sums)
    sizes = np.bincount((rows @ centres.T).argmax(axis=1), minlength=len(centres))
    while len(sums) > 1:
        like = unit(sums) @ unit(sums).T
        np.fill_diagonal(like, -1.0)
        small = int(sizes.argmin())
        a, b = (small, int(like[small].argmax())) if sizes[small] < KIND_ROWS else divmod(int(like.argmax()), len(like))
        if like[a, b] < KIND_COSINE and sizes[small] >= KIND_ROWS:
            break
        sums[b] += sums[a]
        sizes[b] += sizes[a]
        sums, sizes = np.delete(sums, a, axis=0), np.delete(sizes, a)
    centres = unit(sums)
    return (rows @ centres.T).argmax(axis=1), column, centres


class Views(dict):
    """The postings of the terms met so far, for those of more than ``FEW``."""

    def __init__(self, postings: np.ndarray, offsets: np.ndarray):
        super().__init__()
        self.all, self.offsets = memoryview(postings), offsets

    def __missing__(self, term: int) -> memoryview:
        self[term] = view = self.all[self.offsets[term] : self.offsets[term + 1]]
        return view


@dataclass
class Block:
    """Examples ``start`` to ``stop``, and their weights of the terms that many of them hold, a row for each term."""

    start: int
    stop: int
    slots: np.ndarray
    weights: np.ndarray


@dataclass
class Index:
    """Unit TF-IDF vectors of the examples, by term.

    Examples stand by kind and number of terms and are cut into blocks. Terms that are frequent in a block are rows of its matrix
    (``slot`` numbers those that are frequent in any). All else is in postings: an example, and the bits of its weight times the
    term's inverse frequency, in one number. ``rank`` says which of two examples of equal cosine comes first.
    """

    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    rank: np.ndarray
    postings: np.ndarray
    offsets: np.ndarray
    slot: np.ndarray
    blocks: list[Block]
    column: np.ndarray
    centres: np.ndarray

    @staticmethod
    def of(rows: Iterable[tuple[object, int, list[int], list[int]]], idf: np.ndarray) -> Index:
        """``rows``: id, label, terms and counts; of equal cosines that of the first heaviest term, then of the first id leads."""
        marks, terms, weights = [], [], []
        for doc_id, toxic, t, counts in rows:
            if len(t):
                terms.append(np.array(t, np.int32))
                weights.append(weigh(terms[-1], np.array(counts), idf).astype(np.float32))
                marks.append((int(terms[-1][np.argmax(weights[-1])]), doc_id, toxic))
        sizes = np.array([len(t) for t in terms], np.int64)
        kind, column, centres = _kinds(terms, weights, len(idf))
        order = np.lexsort((sizes, kind))
        rank = np.empty(len(order), np.int64)
        rank[sorted(range(len(marks)), key=lambda i: marks[i][:2])] = np.arange(len(order))
        marks, rank, kind = [marks[i] for i in order], rank[order], kind[order]
        term = np.concatenate([np.zeros(0, np.int32), *(terms[i] for i in order)])
        del terms
        weight = np.concatenate([np.zeros(0, np.float32), *(weights[i] for i in order)])
        del weights
        ends = np.concatenate(([0], sizes[order].cumsum()))
        cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(order)]
        parts = [np.linspace(a, b, -(-(b - a) // ROWS) + 1).astype(int) for a, b in zip(cuts, cuts[1:]) if b > a]
        slot, blocks = np.full(len(idf), -1, np.int32), []
        here, rare = np.full(len(idf), -1, np.int32), np.ones(len(term), bool)
        for start, stop in (pair for part in parts for pair in zip(part[:-1].tolist(), part[1:].tolist())):
            now = slice(ends[start], ends[stop])
            known = np.bincount(term[now], minlength=len(idf))
            frequent = np.flatnonzero(known * DENSE_SHARE > stop - start)
            frequent = frequent[np.argsort(-known[frequent], kind="stable")[:DENSE]]
            new = frequent[slot[frequent] < 0]
            slot[new] = slot.max(initial=-1) + 1 + np.arange(len(new))
            here[:] = -1
            here[frequent] = np.arange(len(frequent))
            at = here[term[now]]
            dense = np.zeros((len(frequent), stop - start), np.float32)
            example = np.repeat(np.arange(stop - start), np.diff(ends[start : stop + 1]))
            dense[at[at >= 0], example[at >= 0]] = weight[now][at >= 0]
            rare[now] = at < 0
            blocks.append(Block(start, stop, slot[frequent], dense))
        # A worker holds little else at a time: several share the memory of an executor.
        postings = np.repeat(np.arange(len(order), dtype=np.int64) << 32, sizes[order])[rare]
        weight = weight[rare]
        term = term[rare]
        weight *= idf.astype(np.float32)[term]
        postings |= weight.view(np.uint32)
        del weight, rare
        offsets = np.concatenate(([0], np.bincount(term, minlength=len(idf)).cumsum()))
        by_term = np.argsort(term, kind="stable")
        del term
        postings = postings[by_term]
        ids, toxic = np.array([m[1] for m in marks], object), np.array([m[2] for m in marks], np.float64)
        return Index(idf, ids, toxic, rank, postings, offsets, slot, blocks, column, centres)

    @cached_property
    def place(self) -> dict:
        return {doc_id: at for at, doc_id in enumerate(self.ids)}

    @cached_property
    def width(self) -> int:
        return max(1, -(-len(self.ids) // BLOCK)) * BLOCK

    @cached_property
    def slots(self) -> int:
        return int(self.slot.max(initial=-1)) + 1

    @property
    def dense(self) -> np.ndarray:
        """All that the blocks hold, as one matrix of examples and slots."""
        out = np.zeros((self.width, self.slots), np.float32)
        for block in self.blocks:
            out[block.start : block.stop, block.slots] = block.weights.T
        return out

    def _rare(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray | None:
        """What the postings of ``terms`` add to the cosine of each example.

        Terms that a text holds equally often differ in their inverse frequency alone, which the postings have already: so there
        is one product for all of them.
        """
        start, stop = self.offsets[terms], self.offsets[terms + 1]
        some = np.flatnonzero(stop > start)
        if not len(some):
            return None
        factor = np.round(weights[some] / self.idf[terms[some]], 12)
        order = np.lexsort((factor, stop[some] - start[some] <= FEW))
        some, factor = some[order], factor[order]
        start, size = start[some], (stop - start)[some]
        many = int((size > FEW).sum())
        both = np.frombuffer(b"".join(map(self.views.__getitem__, terms[some[:many]].tolist())), np.int64)
        ends = size.cumsum()
        total, long = int(ends[-1]), len(both)
        if total > len(self.scratch[0]):
            self.scratch = np.empty(2 * total, np.int64), np.empty(2 * total, np.float64)
        at, by = (x[:total] for x in self.scratch)
        np.right_shift(both, 32, out=at[:long])
        by[:long] = both.view(np.float32)[::2]
        # Most terms are held once, and so have the least factor: it is left to the sums.
        least = factor.min()
        last = np.flatnonzero(np.diff(factor[:many]))
        for a, b in zip(last.tolist(), [*last[1:].tolist(), many - 1]):
            by[ends[a] : ends[b]] *= factor[b] / least
        if many and factor[0] > least:
            by[: ends[last[0] if len(last) else many - 1]] *= factor[0] / least
        if total > long:
            start, size = start[many:], size[many:]
            few = self.postings[np.repeat(start - (size.cumsum() - size), size) + np.arange(total - long)]
            np.right_shift(few, 32, out=at[long:])
            by[long:] = few.view(np.float32)[::2] * np.repeat(factor[many:] / least, size)
        sums = np.bincount(at, by, self.width)
        sums *= least
        return sums

    @cached_property
    def views(self) -> Views:
        return Views(self.postings, self.offsets)

    @cached_property
    def scratch(self) -> tuple[np.ndarray, np.ndarray]:
        """Room for the postings of one text, kept from text to text."""
        return np.empty(1 << 16, np.int64), np.empty(1 << 16, np.float64)

    def _together(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[int]]:
        """Numbers of texts of one kind and like length, at most ``TEXTS`` at a time: these hold many of the same terms."""
        kinds = []
        for terms, weights in texts:
            at = self.column[terms]
            kinds.append(int((weights[at >= 0] @ self.centres.T[at[at >= 0]]).argmax()))
        kind = np.array(kinds, np.int64)
        size = np.array([len(terms) for terms, _ in texts])
        for k in np.unique(kind):
            members = np.flatnonzero(kind == k)
            members = members[np.argsort(size[members], kind="stable")]
            yield from (part.tolist() for part in np.array_split(members, -(-len(members) // TEXTS)))

    def nearest_of(
        self, texts: list[tuple[np.ndarray, np.ndarray]], k: int, but: list | None = None
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of ``texts`` (terms, weights) the ``k`` examples of highest cosine; ties go to the one of lower rank.

        No example is passed over: the frequent terms of each block are one product of matrices, without the terms that none of
        the texts hold, to which the rare terms of each text are added. Weights have single precision.
        """
        out: list = [None] * len(texts)
        for members in self._together(texts):
            query = np.zeros((len(members), self.slots), np.float32)
            for i, m in enumerate(members):
                terms, weights = texts[m]
                slot = self.slot[terms]
                query[i, slot[slot >= 0]] = weights[slot >= 0]
            used = query.max(axis=0) > 0
            score = np.zeros((len(members), self.width), np.float32)
            for block in self.blocks:
                here = np.flatnonzero(used[block.slots])
                if len(here):
                    right = block.weights if len(here) == len(block.slots) else block.weights[here]
                    score[:, block.start : block.stop] = query[:, block.slots[here]] @ right
            for row, m in zip(score, members):
                rare = self._rare(*texts[m])
                if rare is not None:
                    row += rare
                if but is not None and but[m] in self.place:
                    row[self.place[but[m]]] = 0
                out[m] = self._best(row, k)
        return out

    def _best(self, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        # As many blocks as examples are wanted reach the lower of these bounds, so as many examples do.
        runs = score.reshape(-1, BLOCK)
        best = runs.max(axis=1)
        least = np.partition(best, -k)[-k] if len(best) >= k else 0.0
        reach = np.flatnonzero(best >= least - 1e-6)
        run, place = np.nonzero((runs[reach] > 0) & (runs[reach] >= least - 1e-6))
        found = reach[run] * BLOCK + place
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], -k)[-k] - 1e-6]
        found = found[np.lexsort((self.rank[found], -np.round(score[found], 6)))[:k]]
        return found, score[found].astype(np.float64)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: object = None) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([(terms, weights)], k, None if but is None else [but])[0]

    def votes(self, texts: list[bytes], prior: float, but: list | None = None) -> list[tuple[float, list]]:
        """Share of toxic votes among the neighbours, by cosine, and the ids of the three nearest; -1 without neighbours."""
        out: list[tuple[float, list]] = [(-1.0, [])] * len(texts)
        usable = [i for i, packed in enumerate(texts) if packed and len(self.ids)]
        for start in range(0, len(usable), WINDOW):
            now = usable[start : start + WINDOW]
            split = (_unpack(texts[i]) for i in now)
            vectors = [(terms.astype(np.int32), weigh(terms, counts, self.idf)) for terms, counts in split]
            near = self.nearest_of(vectors, NEIGHBOURS, None if but is None else [but[i] for i in now])
            for i, (found, score) in zip(now, near):
                if len(found):
                    share = (float(score @ self.toxic[found]) + PRIOR_VOTES * prior) / (float(score.sum()) + PRIOR_VOTES)
                    out[i] = share, list(self.ids[found[:3]])
        return out


class Examples:
    """The packed vectors of the examples; their index is built where it is used, once per process."""

    def __init__(self, table: pa.Table, idf: np.ndarray):
        self.table, self.idf = table, idf

    @cached_property
    def index(self) -> Index:
        columns = (self.table.column(c).to_pylist() for c in ("doc_id", "toxic", "terms"))
        return Index.of(((i, toxic, *_unpack(packed)) for i, toxic, packed in zip(*columns)), self.idf)


def weigh(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weight = (1 + np.log(counts)) * idf[terms]
    return weight / np.linalg.norm(weight)


def _voted(vectors: DataFrame, index: Broadcast, prior: float, leave_out: bool = False) -> DataFrame:
    kind = dict(vectors.dtypes)["doc_id"]
    names = ["doc_id", *(["toxic"] if leave_out else [])]
    schema = f"doc_id {kind}, {'toxic int, ' if leave_out else ''}vote double, evidence array<{kind}>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "terms"))
            keys = list(zip(ids, texts)) if leave_out else texts
            place = {key: i for i, key in enumerate(keys)}
            chosen = list(place.values())
            found = index.value.index.votes([texts[i] for i in chosen], prior, [ids[i] for i in chosen] if leave_out else None)
            seen = dict(zip(place, found))
            votes, near = [seen[key][0] for key in keys], [seen[key][1] for key in keys]
            arrays = [*(batch.column(c) for c in names), pa.array(votes, pa.float64())]
            arrays.append(pa.array(near, pa.list_(batch.schema.field("doc_id").type)))
            yield pa.RecordBatch.from_arrays(arrays, [*names, "vote", "evidence"])

    return vectors.select(*names, "terms").mapInArrow(work, schema)


def _bin(vote: Column) -> Column:
    return F.when(vote < 0, -1).otherwise(F.least(F.floor(vote * BINS), F.lit(BINS - 1))).cast("int")


def _calibration(votes: DataFrame, prior: float) -> dict[int, float]:
    """Share of toxic examples by bin of the vote that each gets from the other examples, made monotone."""
    counts = {r["bin"]: (r["n"], r["t"]) for r in votes.groupBy(_bin(F.col("vote")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).collect()}
    shrunk = lambda n, t: ((t + prior) / (n + 1.0), n + 1.0)
    pools: list[list] = []
    for b in range(BINS):
        share, weight = shrunk(*counts.get(b, (0, 0))) if b in counts else ((b + 0.5) / BINS, 0.1)
        pools.append([share, weight, [b]])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            high, low = pools.pop(), pools.pop()
            weight = high[1] + low[1]
            pools.append([(high[0] * high[1] + low[0] * low[1]) / weight, weight, low[2] + high[2]])
    out = {b: share for share, _, members in pools for b in members}
    out[-1] = shrunk(*counts.get(-1, (0, 0)))[0]
    return out


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` for every row of ``docs(doc_id, text)``.

    Examples are at most ``MAX_EXAMPLES`` labelled documents outside the held-out fold (``crc32(doc_id) % 5 = 0``). Terms are
    words and their beginnings, all those of the examples; each weighs the more the better it tells the labels of the
    examples apart, and none is left out (words that no example holds cannot meet one). Their document frequencies
    come from all documents. The score is the share of toxic votes among the nearest examples, calibrated on
    the examples themselves, each voted on by the others. ``evidence`` lists the nearest examples. Texts that are
    null, empty or without a term of the examples get the share of toxic examples of that kind. Rows without an id are scored,
    and not held out. Several labels of a document count as toxic if one is; null labels are ignored; without both labels
    every score is the share of toxic labels. Repeated rows are scored alike.
    """
    importable(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    kind = dict(docs.dtypes)["doc_id"]
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast(kind).alias("doc_id"))
    usable = usable.agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).where(fold(F.col("doc_id")) != 0)
    chosen = checkpointed(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES))
    texts = docs.select("doc_id", "text")
    train = join_checked(texts, chosen, ["doc_id"], "inner")
    names, lean = _term_counts(train)
    size = len(names)
    terms = context.broadcast(Terms(names))
    vectors = checkpointed(_vectors(texts, terms))
    n = vectors.count()
    idf = np.full(max(1, size), math.log(n + 1.0) + 1.0)
    if size:
        idf = (np.log((n + 1.0) / (_frequencies(vectors, size) + 1.0)) + 1.0) * (1 + lean) ** LEAN_POWER
    examples = checkpointed(join_checked(vectors, chosen, ["doc_id"], "inner").dropDuplicates(["doc_id"]))
    kept = examples.select("doc_id", "toxic", "terms").toArrow()
    prior = (sum(kept.column("toxic").to_pylist()) + 0.5) / (kept.num_rows + 1.0)
    index = context.broadcast(Examples(kept, idf))
    # A few thousand short rows would share one partition, and so one core.
    spread = examples.repartition(context.defaultParallelism)
    table = _calibration(checkpointed(_voted(spread, index, prior, leave_out=True)), prior)
    calibrated = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])[_bin(F.col("vote"))]
    voted = _voted(vectors, index, prior).select("doc_id", "evidence", calibrated.alias("score"))
    return voted.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "evidence",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
