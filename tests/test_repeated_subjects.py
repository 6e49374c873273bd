"""Subjects on several rows, up to one that holds a third of the table, against plain Python."""

import random
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from tests.brute import by_subject, slot_rules, subject_rules
from tests.helpers import AS_OF, LAYOUT, PACK, SETTINGS, table

from cohortcheck import Limits, Settings, normalize, validate, violations
from cohortcheck.operators.joins import KeyStats, attach, rows_of
from cohortcheck.operators.neighbours import in_ranges
from cohortcheck.plans.contexts import RowContext, SubjectContext
from cohortcheck.plans.validation import use_checkpoints

SLOT_RULES = ("V27", "V28", "V29", "V30", "V31", "V34", "V35", "V36", "V37")
SUBJECT_RULES = tuple(r.rule_id for r in PACK.rules if r.rule_id >= "V38")
DAYS = [c for c in (
    "vl_1_date vl_2_date shot1_date shot2_date shot3_date counsel_1_date counsel_2_date screen_1_date "
    "screen_2_date rx_date discontinued_date"
).split()]


def random_changes(n, seed=1):
    """Rows of random dates and codes; a third of them belong to subject 7."""
    rng = random.Random(seed)

    def day():
        if rng.random() < 0.25:
            return None
        offset = rng.choice([-30, 2000]) if rng.random() < 0.1 else rng.randrange(0, 200)
        return (AS_OF.replace(year=2021, month=2, day=1) + timedelta(offset)).isoformat()

    def code(*values):
        return rng.choice([*values, None])

    out = []
    for i in range(n):
        subject = "7" if i % 3 == 0 else str(100 + rng.randrange(n // 3))
        change = {name: day() for name in DAYS}
        change |= {f"shot{s}_dose": code("1", "2", "3", "4", "5", "6", "9") for s in (1, 2, 3)}
        change |= {"vl_1_result": code("1"), "vl_2_result": code("1"), "rx": code("0", "1", "1", "1", "2")}
        change |= {f"{e}_ever": code("0", "1") for e in ("counsel", "screen")}
        change |= {f"counsel_{s}_outcome": code("1", "3") for s in (1, 2)}
        change |= {f"screen_{s}_outcome": code("0", "1") for s in (1, 2)}
        change |= {"discontinued": code("0", "1"), "vl_pre_result": code("1")}
        # Row ids in no particular order, and far apart.
        out.append({**change, "subject_id": subject, "row_id": (i * 7919) % 100_003 * 1_000})
    return out


LIMITS = {
    "all in one": Limits(),
    "small ranges": Limits(chunk_rows=7),
    "shuffled keys": Limits(max_broadcast_keys=1, hot_key_rows=20),
    "few bytes": Limits(max_broadcast_bytes=1, hot_key_rows=20),
    "everything small": Limits(max_broadcast_keys=3, hot_key_rows=5, chunk_rows=3),
}


@pytest.fixture(scope="module")
def data(spark):
    typed = normalize(table(spark, *random_changes(240)), LAYOUT, drop_keyless=False).cache()
    return typed, [r.asDict() for r in typed.collect()]


@pytest.mark.parametrize("name", LIMITS)
def test_slot_rules(data, name):
    typed, rows = data
    settings = Settings(as_of=AS_OF, limits=LIMITS[name])
    got = violations(typed, PACK.only(*SLOT_RULES), settings, LAYOUT).collect()
    slots = {(r.rule_id, r.row_id, int((r.column2 or r.column1).strip("shotvl_").split("_")[0])) for r in got}
    want = set()
    for subject in by_subject(rows).values():
        want |= slot_rules(subject, AS_OF, (1, 2, 3), (1, 2))
    assert slots == want
    assert len(got) == len(want)
    # The shown values are those of the row and of the slot before it.
    cell = {(r["row_id"], c): r[c] for r in rows for c in r}
    for r in got:
        value = r.value2 if r.column2 else r.value1
        shown = cell[r.row_id, r.column2 or r.column1]
        assert value == (None if shown is None else str(shown))


@pytest.mark.parametrize("mode", ["default", "strict"])
@pytest.mark.parametrize("name", ["all in one", "everything small"])
def test_subject_rules(data, name, mode):
    typed, rows = data
    settings = Settings(as_of=AS_OF, mode=mode, limits=LIMITS[name])
    got = violations(typed, PACK.only(*SUBJECT_RULES), settings, LAYOUT).collect()
    want = {(k, rule) for k, subject in by_subject(rows).items() for rule in subject_rules(subject, AS_OF, mode)}
    assert {(r.subject_id, r.rule_id) for r in got} == want
    # One violation per subject, rule and columns, however many rows the subject has.
    assert len({(r.subject_id, r.rule_id, r.column1, r.column2) for r in got}) == len(got)


def test_limits_do_not_change_the_report(data):
    typed, _ = data
    reports = [
        sorted(map(str, violations(typed, PACK, Settings(as_of=AS_OF, limits=limits), LAYOUT).collect()))
        for limits in LIMITS.values()
    ]
    assert all(report == reports[0] for report in reports[1:])


def test_row_order_and_partitioning_do_not_matter(data):
    typed, _ = data
    once = violations(typed, PACK, SETTINGS, LAYOUT)
    again = violations(typed.repartition(5, "zip_code").orderBy("rx_date"), PACK, SETTINGS, LAYOUT)
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


def test_identical_copies_of_one_row(spark):
    df = table(spark, *[{"subject_id": "5"}] * 50)
    typed = normalize(df, LAYOUT, drop_keyless=False)
    settings = Settings(as_of=AS_OF, limits=Limits(chunk_rows=4))
    got = violations(typed, PACK.only("V01", "V30"), settings, LAYOUT).collect()
    assert sum(r.rule_id == "V01" for r in got) == 50
    # Two dated slots on 50 rows: every slot but the first row's has an equal day just before it.
    assert sum(r.rule_id == "V30" for r in got) == 98


@pytest.mark.parametrize("ids", [(0, None), (5, 5)])
def test_rows_of_a_subject_need_ids(spark, ids):
    df = table(spark, *[{"subject_id": "1", "row_id": i} for i in ids])
    with pytest.raises(Exception, match="need ids that differ"):
        validate(df, PACK, SETTINGS, LAYOUT).report.collect()


def test_facts_keep_findings_short(spark):
    def longest(slots: int) -> int:
        names = [f"{e}_{i}_{part}" for e in ("counsel", "screen") for i in range(1, slots + 1) for part in ("date", "outcome")]
        df = normalize(table(spark, dict.fromkeys(names)), LAYOUT, drop_keyless=False)
        ctx = RowContext(dict(df.dtypes), LAYOUT, SETTINGS)
        return max(len(f.when) for rule in PACK.only("V48", "V49").rules for f in rule.findings(ctx))

    assert longest(40) < 1.2 * longest(4)


@pytest.mark.parametrize("at", [0, 3, 7])
def test_a_partly_repeated_id_is_refused(spark, at):
    ids = [*range(8), at]
    df = table(spark, *[{"subject_id": "1", "row_id": i} for i in ids])
    with pytest.raises(Exception, match="need ids that differ"):
        validate(df, PACK, SETTINGS, LAYOUT).report.collect()


def test_ranges_are_even_however_ids_cluster(spark):
    # Two neighbouring files, as Spark numbers them: ids fill the ends of a span of 2^33.
    ids = [*range(6000), *range(1 << 33, (1 << 33) + 2000)]
    rows = spark.createDataFrame([(k, i) for k in ("1", "2") for i in ids] + [("3", 5)], "subject_id string, row_id long")
    rows = rows.withColumn("_n_rows", F.when(F.col("subject_id") == "3", 1).otherwise(len(ids)))
    use_checkpoints(spark)
    cut = in_ranges(rows, ["subject_id"], "row_id", 2 * len(ids), 1000).where("subject_id <> '3'")
    got = cut.groupBy("subject_id", "_chunk").agg(F.expr("count(1) AS n"), F.expr("min(row_id) AS a"), F.expr("max(row_id) AS b"))
    got = sorted(got.collect(), key=lambda r: (r.subject_id, r._chunk))
    assert sum(r.n for r in got) == 2 * len(ids)
    assert max(r.n for r in got) < 2000
    assert all(x.b < y.a for x, y in zip(got, got[1:]) if x.subject_id == y.subject_id)


def test_many_keys_are_joined_plainly(spark, tmp_path):
    """Beyond what may be broadcast, Spark filters the rows by a Bloom filter of its own before it shuffles them."""
    spark.range(200_000).selectExpr("CAST(id AS STRING) AS k", "id AS row", "'wide' AS cell").write.parquet(str(tmp_path / "rows"))
    per_key = spark.range(0, 200_000, 40).selectExpr("CAST(id AS STRING) AS k", "2L AS _n_rows")
    per_key.write.parquet(str(tmp_path / "keys"))
    rows, per_key = (spark.read.parquet(str(tmp_path / n)) for n in ("rows", "keys"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = rows_of(rows, per_key, ["k"])
        assert "might_contain" in joined._jdf.queryExecution().optimizedPlan().toString()
        assert joined.count() == 5000 and joined.columns == ["k", "row", "cell", "_n_rows"]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above(text, node):
    """The nodes above the first line that names ``node``, nearest first."""
    # Literals with line breaks spill over several lines; nodes start with a branch of the tree.
    lines = [line for line in text.split("\n") if re.match(r"[ :]*[:+]- ", line)]
    at = next(i for i, line in enumerate(lines) if node in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    out, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            out.append(line.strip(" :+-"))
    return out


@pytest.mark.parametrize("limit", [{}, {"max_broadcast_keys": 1}, {"max_broadcast_bytes": 1}])
def test_rows_of_their_own_are_never_shuffled(spark, data, tmp_path, limit):
    path = str(tmp_path / "typed")
    data[0].write.parquet(path)
    settings = Settings(as_of=AS_OF, limits=Limits(**limit))
    # Spark itself would broadcast tables as small as these.
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(violations(spark.read.parquet(path), PACK, settings, LAYOUT))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    nodes = [n.split()[0].split("(")[0] for n in above(text, "FileScan")]
    assert "Generate" in nodes
    if "Exchange" in nodes:
        assert nodes.index("Generate") < nodes.index("Exchange")
    assert bool(limit) == ("Exchange" in nodes)


def test_rows_of_hot_keys_are_spread(spark):
    # The salt must stay a key of the join, or the shuffle would send a hot key to one task.
    rows = spark.range(1000).selectExpr("CAST(if(id < 600, 0, id) AS STRING) AS k", "id AS row")
    per_key = rows.groupBy("k").agg(F.expr("count(1) AS _n_rows"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach(rows, per_key, ["k"], "row", KeyStats.of(per_key), max_broadcast_keys=5, hot_key_rows=100)
        text = plan(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    shuffles = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)
    assert len([keys for keys in shuffles if "_salt" in keys]) == 2
    assert joined.where("_n_rows = 600").count() == 600 and joined.count() == 1000


@pytest.mark.parametrize("mode", ["default", "strict"])
def test_last_event_takes_a_hash_aggregate(spark, data, mode):
    typed, _ = data
    ctx = SubjectContext(dict(typed.dtypes), LAYOUT, Settings(as_of=AS_OF, mode=mode))
    for rule in PACK.only("V45", "V46").rules:
        list(rule.findings(ctx))
    rows = typed.selectExpr("*", "0L AS _first_row", "1L AS _last_row")
    text = plan(ctx.about_subjects(rows))
    assert "HashAggregate" in text and "SortAggregate" not in text
