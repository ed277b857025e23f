"""Operators that split hot groups give what the plain form gives."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditloom import schemas
from auditloom.operators import dependencies, files
from auditloom.operators.compare import compare_scans, score_history
from auditloom.operators.findings import scan_summary, security_scores
from auditloom.operators.history import fill_history_context, history_findings
from auditloom.operators.topk import first_per_group, ranked_per_group
from auditloom.session import broadcast_if_small, durable
from auditloom.streaming import scans
from tests.helpers import files_table, log_lines

SECRET = "token = '" + "abcdefghijkl" + "'"


def test_first_per_group(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.8 else f"g{i % 5}", i, rnd.randrange(50)) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    order = [F.col("v").desc(), F.col("i")]
    for k in (1, 7, 100):
        got = first_per_group(df, ["g"], order, k, salt_on=["i"], salts=8)
        plain = df.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
        want = plain.filter(F.col("position") <= k)
        assert sorted(got.collect()) == sorted(want.collect())


def test_history_context_over_block_borders(spark):
    rnd = random.Random(2)
    kinds = ["commit:" + "%040d", "+++ b/f%d", "+++ /dev/null", "+x", " y", "-z"]
    lines = [k % i if "%" in k else k for i, k in enumerate(rnd.choices(kinds, k=200))]
    log = spark.createDataFrame(log_lines("a", *lines) + log_lines("b", "+x"), schemas.GIT_LOG)
    commit, file, want = "unknown", "git-history", {}
    for i, line in enumerate(lines):
        if line.startswith("commit:"):
            commit = line[7:19]
        elif line.startswith("+++ b/"):
            file = line[6:]
        want[i] = (commit, file)
    for block in (1, 3, 50, 1000):
        rows = fill_history_context(log, block).collect()
        got = {r.seq: (r.commit, r.file) for r in rows if r.scan_id == "a"}
        assert got == want
        assert [(r.commit, r.file) for r in rows if r.scan_id == "b"] == [("unknown", "git-history")]


def test_history_findings_read_added_lines_only(spark):
    log = log_lines(
        "s", "commit:" + "d" * 40, "+++ b/a.js", "+" + SECRET, "-" + SECRET, " " + SECRET,
        "++" + SECRET, "+++" + SECRET, "+++ /dev/null", "+" + SECRET,
    )
    rows = history_findings(spark.createDataFrame(log, schemas.GIT_LOG)).collect()
    assert sorted(r.ord.n for r in rows) == [2, 5, 8]
    assert {(r.file, r.commit, r.line, r.tool) for r in rows} == {
        ("a.js", "d" * 12, 1, "Git history")
    }


def test_score_history_over_block_borders(spark):
    rnd = random.Random(3)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [
        ("hot" if rnd.random() < 0.7 else f"u{i % 3}", f"s{i:03}",
         start + timedelta(minutes=rnd.randrange(600)), rnd.randrange(100))
        for i in range(200)
    ]
    scans = spark.createDataFrame(rows, "url string, scan_id string, created_at timestamp, score int")
    before = F.lag("score").over(Window.partitionBy("url").orderBy("created_at", "scan_id"))
    want = scans.select("url", "scan_id", "created_at", "score", (F.col("score") - before).alias("c"))
    for block in ("minute", "hour", "day", "month"):
        got = score_history(scans, block)
        assert sorted(got.collect(), key=str) == sorted(
            want.withColumnRenamed("c", "score_change").collect(), key=str
        )


def test_byte_budget_without_a_file_limit(spark):
    rows = [("hot", f"d{i % 7}/f{i}.js", "x" * (i * 37 % 90)) for i in range(400)]
    rows += [("small", "a.js", "x" * 50), ("small", "b.js", ""), ("none", "c.js", "x" * 95)]
    table = files_table(spark, rows)
    spared = {"max_bytes": 3_000, "max_file_bytes": 80}
    got = {
        (r.scan_id, r.path): (r.running_bytes, r.is_large, r.taken)
        for r in files.select_files(table, None, **spared).collect()
    }
    want, total = {}, {}
    for scan, path, text in sorted(rows, key=lambda r: (r[0], r[1].split("/"))):
        large = len(text) > 80
        total[scan] = total.get(scan, 0) + (0 if large else len(text))
        want[scan, path] = (total[scan], large, not large and total[scan] <= 3_000)
    assert got == want
    limited = files.select_files(table, 1_000, **spared)
    assert {(r.scan_id, r.path): (r.running_bytes, r.is_large, r.taken) for r in limited.collect()} == want
    assert files.scan_volume(files.select_files(table, None, **spared)).filter("truncated").count() == 1


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_advisories_and_baselines_are_not_sent_through_the_driver(spark):
    def row(**values):  # of a small estimate, as compressed files have
        return durable(spark.createDataFrame([values]))

    inventory = row(scan_id="s", file="a/package-lock.json", walk="a", ecosystem="npm", name="x", version="1.0", pos=0)
    found = dependencies.advisory_findings(
        inventory, row(ecosystem="npm", name="x", version="1.0", id="A-1", summary="", severity="high"))
    below = dependencies.baseline_findings(inventory, row(name="x", below="2.0", severity="high", advisory="A-2"))
    assert "Broadcast" not in _plan(found) and "Broadcast" not in _plan(below)
    assert [r.rule for r in found.collect()] == ["A-1"] and [r.rule for r in below.collect()] == ["DEP-X"]


def test_snapshots_of_the_fallback_are_not_sent_through_the_driver(spark):
    def row(**values):
        return durable(spark.createDataFrame([values]))

    inventory = row(scan_id="s", file="a/package-lock.json", walk="a", ecosystem="npm", name="x", version="1.0", pos=0)
    known = row(ecosystem="npm", name="x", version="1.0", id="A-1", summary="", severity="high")
    below = row(name="x", below="2.0", severity="high", advisory="A-2")
    for online, rule in ((True, "A-1"), (False, "DEP-X")):
        scans = row(scan_id="s", advisories_available=online)
        found = dependencies.dependency_findings(inventory, known, below, scans)
        assert "Broadcast" not in _plan(found)
        assert [r.rule for r in found.collect()] == [rule]
        assert "Broadcast" not in _plan(found)


def test_ids_of_a_large_batch_are_merged_not_sent_to_the_driver(spark):
    rows = durable(spark.range(60_000).selectExpr("concat('cust-', id) as scan_id"))
    tables = scans.SnapshotTables(*[rows] * 5)
    for n, small in ((10, True), (60_000, False)):
        own = tables.of(rows.limit(n))
        for df in (own.files, own.git_log, own.reports):
            assert ("Broadcast" in _plan(df)) == small
            assert df.count() == n


def test_rows_beyond_the_bound_are_merged_however_small_their_files_are(spark):
    rows = spark.range(100).selectExpr("cast(id as string) as k")
    few, many = (broadcast_if_small(rows, bound) for bound in (1_000_000, 10))
    assert "BroadcastHashJoin" in _plan(rows.join(few, "k", "left_semi"))
    assert "Broadcast" not in _plan(rows.join(many, "k", "left_semi"))


def test_ranked_per_group_moves_rows_once_and_cuts_hot_groups(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i // 2, i // 2 % 4) for i in range(600)]
    df = durable(spark.createDataFrame(rows, "g string, i int, v int"))
    unique = df.distinct()
    want = sorted(unique.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("v", "i"))).collect())
    for hot_rows in (1, 100, 10_000):
        got = ranked_per_group(df, ["g"], ["v", "i"], "n", hot_rows, distinct=True)
        assert sorted(got.collect()) == want
        assert sorted(ranked_per_group(durable(unique), ["g"], ["v", "i"], "n", hot_rows).collect()) == want
    plan = _plan(ranked_per_group(df, ["g"], ["v", "i"], "n", distinct=True))
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_tables_with_a_row_per_scan_are_not_sent_to_the_driver(spark):
    def row(**values):
        return durable(spark.createDataFrame([values]))

    found = row(scan_id="s", severity="high", rule="R", file="f", line=1, fingerprint="")
    volume = row(scan_id="s", files_scanned=1, bytes_scanned=1, skipped_large_files=0, truncated=False,
                 truncation_reason="")
    flags = row(scan_id="s", history_available=True, external_tools=["Semgrep"])
    scans = durable(spark.createDataFrame(
        [("s", "p", 5), ("p", None, 7)], "scan_id string, previous_scan_id string, score int"))
    for df in (scan_summary(volume, found, flags), security_scores(found, volume), compare_scans(scans, found)):
        assert "Broadcast" not in _plan(df)
        got = df.collect()
        assert len(got) == 1 and "Broadcast" not in _plan(df)
