"""Near duplicates among documents: ProbMinHash signatures, bands, verification, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcheck.llm.common import (
    checkpointed,
    chunks,
    importable,
    join_checked,
    mix64,
    read_table,
    shingle_hashes,
)
from cohortcheck.llm.graph import components

SHINGLE = 5
MIN_SIMILARITY = 0.8
# A pair at the threshold shares no band with a probability of (1 - 0.8 ** 4) ** 20 = 3e-5.
BANDS = 20
ROWS = 4
# Members of a bucket that one task compares with as many others at once.
BLOCK = 512
# Registers that must agree before texts are fetched: six standard deviations below the mean at the threshold.
LEAST_AGREEING = int(BANDS * ROWS * MIN_SIMILARITY - 6 * (BANDS * ROWS * MIN_SIMILARITY * (1 - MIN_SIMILARITY)) ** 0.5)


def weights(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle and how often it occurs there, sorted by text and shingle."""
    owner, shingle = shingle_hashes(texts, width)
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    first = np.flatnonzero(new)
    return owner[first], shingle[first], np.diff(np.append(first, len(owner)))


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, size: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash of ``n`` weighted sets: ``size`` registers each, equal with a probability of their J_P.

    Every shingle is a Poisson process with its weight as rate; each arrival falls on a register at random, and a
    register keeps the shingle that came first. A shingle's arrivals follow from its hash alone. It leaves the
    race once its next arrival is later than all registers of its text, so most need only one or two.
    """
    time = np.full(n * size, np.inf)
    kept = np.zeros(n * size, np.uint64)
    clock = np.zeros(len(owner))
    step = 0
    while len(owner):
        step += 1
        salt = np.uint64((step * 0xD1342543DE82EF95) % (1 << 64))
        random = mix64(shingle ^ mix64(np.full(1, salt, np.uint64)))
        clock = clock - np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / weight
        place = owner * size + (mix64(random) % np.uint64(size)).astype(np.int64)
        before = time[place]
        np.minimum.at(time, place, clock)
        won = (clock < before) & (clock == time[place])
        kept[place[won]] = shingle[won]
        last = time.reshape(n, size).max(axis=1)
        alive = clock < last[owner]
        owner, shingle, weight, clock = owner[alive], shingle[alive], weight[alive], clock[alive]
    return kept.reshape(n, size)


def bands(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key per band, different for equal registers in different bands."""
    n = len(registers)
    grouped = registers.reshape(n, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], (n, BANDS)).copy()
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ grouped[:, :, r])
    return key.view(np.int64)


def agreement(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many registers agree in their low byte, pair by pair."""
    left = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    return (left == np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)).sum(axis=1)


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets (shingles ascending, weights): the sum over common d of 1 / sum max(x'/x_d, y'/y_d).

    Sorted by the ratio x_d / y_d, each inner sum is a sum of x above the ratio and of y below it.
    """
    if not len(x[0]) or not len(y[0]):
        return 0.0
    both, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    common_x, common_y = x[1][i].astype(np.float64), y[1][j].astype(np.float64)
    only_x, only_y = x[1].sum() - common_x.sum(), y[1].sum() - common_y.sum()
    ratio = common_x / common_y
    order = np.argsort(ratio)
    ratio, common_x, common_y = ratio[order], common_x[order], common_y[order]
    above = only_x + common_x[::-1].cumsum()[::-1]
    below = only_y + np.concatenate(([0.0], common_y.cumsum()[:-1]))
    return float((common_x / (above + ratio * below)).sum())


def _signed(docs: DataFrame) -> DataFrame:
    """``doc_id, key, bands``: equal keys mean equal words; texts without words have nulls."""
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = [(t or "").lower() for t in batch.column("text").to_pylist()]
            for start, stop in chunks(texts):
                part = texts[start:stop]
                owner, shingle, weight = weights(part)
                registers = signatures(owner, shingle, weight, len(part))
                keys = bands(registers)
                low = (registers & np.uint64(255)).astype(np.uint8)
                filled = np.zeros(len(part), bool)
                filled[owner] = True
                digests = [_digest(t) if f else None for t, f in zip(part, filled)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[start:stop], batch.schema.field("doc_id").type),
                        pa.array(digests, pa.binary()),
                        pa.array([k if f else None for k, f in zip(keys, filled)], pa.list_(pa.int64())),
                        pa.array([r.tobytes() for r in low], pa.binary()),
                    ],
                    ["doc_id", "key", "bands", "registers"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, key binary, bands array<long>, registers binary"
    )


def _alike(pairs: DataFrame, registers: DataFrame) -> DataFrame:
    """The ``pairs(a, b)`` whose registers agree often enough; a few bytes per document instead of its text."""
    first = registers.select(F.col("id").alias("a"), F.col("registers").alias("ra"))
    second = registers.select(F.col("id").alias("b"), F.col("registers").alias("rb"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "ra", "rb")
    kind = dict(pairs.dtypes)["a"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = agreement(batch.column("ra").to_pylist(), batch.column("rb").to_pylist())
                yield batch.select(["a", "b"]).filter(pa.array(n >= LEAST_AGREEING))

    return joined.mapInArrow(work, f"a {kind}, b {kind}")


def _digest(lowered: str) -> bytes:
    """128 bits of the words with single blanks; ASCII white space alone parts words."""
    return hashlib.md5(b" ".join(lowered.encode("utf-8", "surrogatepass").split())).digest()


def _verified(pairs: DataFrame, docs: DataFrame, min_similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` of documents whose similarity reaches the threshold.

    Only texts that occur in a pair move: pairs meet their second text where that lies if they are few enough
    to be sent around, else by a shuffle; the first text follows by a join on ``a``, whose hot keys adaptive
    execution splits.
    """
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    firsts = checkpointed(pairs.select("a").distinct())
    seconds = join_checked(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), pairs, ["b"], "inner")
    hubs = join_checked(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), firsts, ["a"], "left_semi")
    joined = seconds.join(hubs, "a").select("a", "b", "text_a", "text_b")
    kind = dict(pairs.dtypes)["a"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, tuple] | None = None

        def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
            _, shingle, weight = weights([(text or "").lower()])
            return shingle, weight

        for batch in batches:
            good = []
            for text_a, text_b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                # Pairs come sorted by their first document.
                if last is None or last[0] != text_a:
                    last = text_a, shingles(text_a)
                good.append(similarity(last[1], shingles(text_b)) >= min_similarity - 1e-12)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(work, f"a {kind}, b {kind}")


def _shingled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, shingles, weights`` of the documents in ``ids(id)``, as packed 64- and 32-bit numbers."""
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    wanted = join_checked(texts, ids, ["id"], "left_semi")
    kind = dict(ids.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles, counts = [], []
            for text in batch.column("text").to_pylist():
                _, shingle, weight = weights([(text or "").lower()])
                shingles.append(shingle.tobytes())
                counts.append(weight.astype(np.int32).tobytes())
            arrays = [batch.column("id"), pa.array(shingles, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "shingles", "weights"])

    return wanted.mapInArrow(work, f"id {kind}, shingles binary, weights binary").dropDuplicates(["id"])


def similar(one: tuple, others: list[tuple], limit: float) -> np.ndarray:
    """Which of ``others`` reach ``limit`` with ``one``; all are (shingles ascending, weights).

    Sets whose weights are all one are compared together, by plain Jaccard, which J_P equals there.
    """
    good = np.zeros(len(others), bool)
    flat = [i for i, x in enumerate(others) if x[1].max() == 1] if one[1].max() == 1 else []
    n = len(one[0])
    flat = [i for i in flat if min(n, len(others[i][0])) >= (limit - 1e-9) * max(n, len(others[i][0]))]
    if flat:
        joined = np.concatenate([others[i][0] for i in flat])
        sizes = np.array([len(others[i][0]) for i in flat])
        hit = one[0][np.minimum(np.searchsorted(one[0], joined), n - 1)] == joined
        common = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], sizes.cumsum()[:-1])))
        good[flat] = common / (n + sizes - common) >= limit - 1e-12
    for i, x in enumerate(others):
        if one[1].max() > 1 or x[1].max() > 1:
            good[i] = similarity(one, x) >= limit - 1e-12
    return good


def _compare(table: pa.Table, limit: float) -> pa.Table:
    """Links between components inside one bucket, or between two of its blocks.

    A pair is looked at in the first band that both share, if its registers agree often enough and its components are not
    joined yet. Returns only links that join components, at most one per member.
    """
    ids = table.column("id").to_pylist()
    part = np.unique(np.array(table.column("part").to_pylist()), return_inverse=True)[1]
    registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint8).reshape(len(ids), -1)
    keys = np.array(table.column("bands").to_pylist(), np.int64)
    at = int(np.argmax(keys[0] == table.column("band")[0].as_py()))
    sets = [
        (np.frombuffer(s, np.uint64), np.frombuffer(w, np.int32))
        for s, w in zip(table.column("shingles").to_pylist(), table.column("weights").to_pylist())
    ]
    block = np.array(table.column("block").to_pylist())
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    first = np.flatnonzero(block == low)
    second = first if low == high else np.flatnonzero(block == high)
    found = []
    for position, i in enumerate(first):
        rest = second[position + 1 :] if low == high else second
        rest = rest[part[rest] != part[i]]
        rest = rest[(registers[rest] == registers[i]).sum(axis=1) >= LEAST_AGREEING]
        rest = rest[~(keys[rest, :at] == keys[i, :at]).any(axis=1)]
        if not len(rest):
            continue
        for j in rest[similar(sets[i], [sets[j] for j in rest], limit)]:
            if part[i] != part[j]:
                part[part == part[j]] = part[i]
                found.append((ids[i], ids[j]))
    kind = table.schema.field("id").type
    return pa.table({"a": pa.array([x for x, _ in found], kind), "b": pa.array([y for _, y in found], kind)})


def _compared(open_: DataFrame, narrow: DataFrame, docs: DataFrame, min_similarity: float) -> DataFrame:
    """Links between components within the buckets ``open_(band, id, part, blocks)``.

    Large buckets are compared block by block, so that a task holds two blocks whatever the bucket's size. Pairs
    exist only inside the tasks.
    """
    ids = checkpointed(open_.select("id").distinct())
    shingled = checkpointed(_shingled(docs, ids))
    details = narrow.select(F.col("rep").alias("id"), "registers", "bands")
    rows = open_.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "band", "id", "part", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    cells = rows.join(shingled.join(details, "id"), "id")
    kind = dict(open_.dtypes)["id"]
    return cells.groupBy("band", "low", "high").applyInArrow(lambda t: _compare(t, min_similarity), f"a {kind}, b {kind}")


def group(docs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``doc_id, class_id, kept`` for every row of ``docs(doc_id, text)``.

    A class joins documents of equal words, and documents linked by a J_P of at least ``min_similarity`` over
    weighted five-word shingles (words in lower case; a shorter text is one shingle). ``class_id`` is its smallest id,
    and that document is ``kept``. Texts that are null or have no word are alone; rows without an id have a null class
    and are kept. Repeated rows of one id are one document. Further columns are ignored.

    Documents of equal words go on as one. In each bucket of a band all members are verified against its most
    central document; members that are still in different components then are compared with each other inside the
    tasks, in blocks, so that no link between components is left untested and no pairs are listed.
    """
    importable(docs.sparkSession)
    signed = checkpointed(_signed(docs))
    known = signed.where("doc_id IS NOT NULL AND key IS NOT NULL")
    reps = checkpointed(known.groupBy("key").agg(F.min("doc_id").alias("rep")))
    mine = ["key", "rep", "bands", "registers"]
    narrow = checkpointed(
        known.withColumnRenamed("doc_id", "rep").select(mine).join(reps, ["key", "rep"]).dropDuplicates(["key"])
    )
    registers = narrow.select(F.col("rep").alias("id"), "registers")
    rows = narrow.select(F.col("rep").alias("id"), F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = checkpointed(rows.join(shared, "band"))

    # Hubs: the document that meets most others over all its bands stands nearest to the middle of its bucket.
    central = members.groupBy("id").agg(F.sum("n").alias("met"))
    ranked = members.join(central, "id").select("band", "id", "met")
    hubs = ranked.groupBy("band").agg(F.min(F.struct((-F.col("met")).alias("met"), "id")).alias("top"))
    members = checkpointed(members.join(hubs.select("band", F.col("top.id").alias("hub")), "band"))
    stars = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    stars = checkpointed(stars)
    links = checkpointed(_verified(checkpointed(_alike(stars, registers)), docs, min_similarity))
    parts = components(links)

    # What the stars left apart: members of one bucket in different components, never compared with each other.
    labelled = members.join(parts, F.col("id") == F.col("node"), "left").select(
        "band", "id", F.coalesce("component", "id").alias("part")
    )
    mixed = labelled.groupBy("band").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("n"))
    mixed = checkpointed(mixed.where("p <> q AND n > 2").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    open_ = checkpointed(join_checked(labelled, mixed, ["band"], "inner"))
    more = checkpointed(_compared(open_, narrow, docs, min_similarity))
    merged = components(links.unionByName(more))

    classes = reps.join(merged, F.col("rep") == F.col("node"), "left")
    classes = checkpointed(classes.select("key", F.coalesce("component", "rep").alias("class")))
    joined = join_checked(signed.select("doc_id", "key"), classes, ["key"])
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
    return joined.select(
        "doc_id", class_id.alias("class_id"), F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept")
    )


def keep_one(docs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``docs`` without the documents that :func:`group` does not keep; a repeated id keeps one row.

    Where the ids to drop are few enough to be sent around, documents stay where they are; else both are shuffled by id.
    """
    verdicts = checkpointed(group(docs, min_similarity).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("kept")))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"))
    dropped = checkpointed(verdicts.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")))
    kept = join_checked(packed, dropped, ["_id"], "left_anti")
    repeated = checkpointed(verdicts.where("kept AND n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")))
    if repeated.isEmpty():
        return kept.select("row.*")
    once = join_checked(kept, repeated, ["_id"], "left_semi").dropDuplicates(["_id"])
    return join_checked(kept, repeated, ["_id"], "left_anti").unionByName(once).select("row.*")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(read_table(spark, sf_dir, "documents"))
