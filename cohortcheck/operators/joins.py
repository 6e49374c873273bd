"""Join per-key records to the rows of a table whose keys may be badly skewed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from cohortcheck.functions import ref
from cohortcheck.operators.keys import N_ROWS

# Most records, and most bytes of them, that are ever sent to every executor.
MAX_BROADCAST_KEYS = 50_000
MAX_BROADCAST_BYTES = 32 << 20
# A key with at least this many rows is joined without moving its rows by key.
HOT_KEY_ROWS = 1_000_000
# Bytes that a value takes in memory besides its text.
_CELL_BYTES = 16

_SALT, _HOT, _COLD = "_salt", "_hot", "_cold"
_SPREAD = 1 << 20
# Keys are marked by a bit each, 64 to a number: half a million records at most are sent, however many keys there are.
_MARKS, _BLOCK, _WORD, _ROWS = 1 << 25, "_block", "_word", "_rows"


def _leaves(kind: DataType) -> int:
    return sum(_leaves(f.dataType) for f in kind.fields) if isinstance(kind, StructType) else 1


@dataclass(frozen=True)
class KeyStats:
    """Number of keys in a per-key table, the rows that they own in all and at most, and the bytes of the widest record."""

    keys: int
    rows: int
    largest: int
    widest: int

    @classmethod
    def of(cls, per_key: DataFrame) -> KeyStats:
        """Measured in one pass over ``per_key``, which should be materialised."""
        texts = " + ".join(f"coalesce(octet_length(CAST({ref(c)} AS STRING)), 0)" for c in per_key.columns)
        got = per_key.agg(
            F.expr("count(1)"),
            F.expr(f"coalesce(sum({N_ROWS}), 0)"),
            F.expr(f"coalesce(max({N_ROWS}), 0)"),
            F.expr(f"coalesce(max({texts}), 0) + {_CELL_BYTES * _leaves(per_key.schema)}"),
        ).first()
        return cls(*got)

    def sendable(self, max_keys: int, max_bytes: int) -> int:
        """How many of the records may be broadcast: at their widest they stay below both bounds."""
        return max(1, min(max_keys, max_bytes // self.widest))


def attach(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    row: str,
    stats: KeyStats,
    max_broadcast_keys: int = MAX_BROADCAST_KEYS,
    hot_key_rows: int = HOT_KEY_ROWS,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    how: str = "inner",
) -> DataFrame:
    """Join ``per_key`` (one record per key, with its row count) to ``rows``; inner or left anti.

    While all records may be broadcast, ``rows`` stay where they are. Beyond that, only the records of hot keys are
    broadcast: a key is hot from ``rows / limit`` rows on, so there cannot be more of them than the limit. The others
    are joined by a shuffle, in which the rows of hot keys, already served, are spread by a salt that matches nothing.
    """
    limit = stats.sendable(max_broadcast_keys, max_broadcast_bytes)
    if stats.keys <= limit:
        return rows.join(F.broadcast(per_key), keys, "left_anti" if how == "anti" else how)
    threshold = max(hot_key_rows, -(-stats.rows // limit))
    record = f"struct({', '.join(ref(c) for c in per_key.columns if c not in keys)})"
    hot = per_key.where(f"{N_ROWS} >= {threshold}").selectExpr(*map(ref, keys), f"{record} AS {_HOT}")
    # Always zero, but no constant: a constant would be taken out of the join's keys, and the salt with it.
    zero = f"pmod(xxhash64({', '.join(map(ref, keys))}), 1L)"
    cold = per_key.where(f"{N_ROWS} < {threshold}").selectExpr(
        *map(ref, keys), f"{zero} AS {_SALT}", f"{record} AS {_COLD}"
    )
    spread = (
        f"CASE WHEN {_HOT} IS NOT NULL OR {ref(keys[-1])} IS NULL "
        f"THEN 1 + pmod(xxhash64({ref(row)}), {_SPREAD}) ELSE 0L END"
    )
    joined = (
        rows.join(F.broadcast(hot), keys, "left")
        .selectExpr("*", f"{spread} AS {_SALT}")
        .join(cold, [*keys, _SALT], "left")
        .selectExpr(*map(ref, rows.columns), f"coalesce({_HOT}, {_COLD}) AS {_HOT}")
    )
    if how == "anti":
        return joined.where(f"{_HOT} IS NULL").drop(_HOT)
    return joined.where(f"{_HOT} IS NOT NULL").selectExpr(*map(ref, rows.columns), f"{_HOT}.*")


def chosen(rows: DataFrame, per_key: DataFrame, keys: list[str], marks: bool = False, others: bool = False) -> DataFrame:
    """The ``rows`` whose key is in ``per_key``, or with ``others`` all but these. What stands for the keys is broadcast.

    That is all of them, or with ``marks`` a mark for each: a bit at the place of its hash. Rows of these keys always have a
    mark; of others few do, one in sixty for half a million keys, so what follows must still look at the key. Rows
    without a key have none. The test is a condition, which Spark takes below projections, as it does not with a join: of rows that it
    leaves out only the key is made.
    """
    # Named by table: a plain name could be found in what is below ``known``.
    mine = [f"{_ROWS}.{ref(k)}" for k in keys]
    place = "pmod(xxhash64({}), {}L)"
    if marks:
        at = place.format(", ".join(map(ref, keys)), _MARKS)
        bits = per_key.selectExpr(f"shiftright({at}, 6) AS {_BLOCK}", f"shiftleft(1L, CAST({at} & 63 AS INT)) AS {_WORD}")
        known = bits.groupBy(_BLOCK).agg(F.expr(f"bit_or({_WORD}) AS {_WORD}"))
        at = place.format(", ".join(mine), _MARKS)
        bit = F.call_function("getbit", F.col(_WORD), F.expr(f"CAST({at} & 63 AS INT)").outer())
        same = (F.col(_BLOCK) == F.expr(f"shiftright({at}, 6)").outer()) & (bit == 1)
    else:
        known = per_key.selectExpr(*[f"{ref(k)} AS _key{i}" for i, k in enumerate(keys)])
        same = reduce(and_, [F.col(f"_key{i}") == F.expr(k).outer() for i, k in enumerate(mine)])
    same = same & F.expr(mine[-1]).outer().isNotNull()
    found = F.broadcast(known).where(same).exists()
    return rows.alias(_ROWS).where(~found if others else found)


def rows_of(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``per_key``, a written table of many keys, to ``rows``, by shuffle.

    A plain join: while the keys are few enough for it, Spark tests ``rows`` with a Bloom filter of them before the shuffle
    (``spark.sql.optimizer.runtime.bloomFilter``), and adaptive execution splits the partitions of hot keys. Both need the
    size of ``per_key``, so it is read from files; the condition, always true, tells Spark that the keys are a selection.
    """
    return rows.join(per_key.where(f"{N_ROWS} > 1"), keys)
