"""Sources and the store."""

import json
import os
import random
import re
from datetime import datetime, timedelta, timezone

import pytest

from auditloom import schemas
from auditloom.sources import archives, history_log, reports, repositories, store
from auditloom.sources.advisories import advisories, advisories_from_replies
from auditloom.plans.scan import Limits, scan_folders
from auditloom.operators.dependencies import default_baselines
from auditloom.sources import snapshot
from auditloom.sources.snapshot import snapshot_files, snapshot_listing


def test_snapshot_names_that_are_not_utf8(spark, tmp_path):
    folder = os.fsencode(str(tmp_path / "snapshots" / "one" / "d"))
    os.makedirs(folder)
    with open(folder + b"/caf\xe9.js", "wb") as f:
        f.write(b"x")
    rows = snapshot_files(spark, str(tmp_path / "snapshots")).collect()
    assert [(r.path, r.content) for r in rows] == [("d/caf\ufffd.js", "x")]


FOLDERS = {
    "one/.github/ci.yml": b"a", "one/pkg/__init__.py": b"b\xff", "one/pkg/deep/er/z.go": b"eval(x)",
    "one/big.js": b"eval(x)\n" + b"x" * 600_000, "one/node_modules/m.js": b"eval(c)", "one/notes.txt": b"eval(n)",
    "one/.env": b"e", "one/prod.ENV": b"p", "one/Dockerfile": b"d", "two/a.js": "\u00e9\r\n".encode(),
    "two/pkg/dist/a.js": b"eval(d)",
}


@pytest.fixture
def folders(tmp_path):
    root = tmp_path / "snapshots"
    for path, data in FOLDERS.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    os.symlink(root / "two", root / "one" / "loop")
    os.symlink(root / "two", root / "three")
    return str(root)


def entered():
    return {p: d for p, d in FOLDERS.items() if "node_modules" not in p and "/dist/" not in p}


def test_snapshot_source(spark, folders):
    got = {(r.scan_id, r.path): (r.entry_type, r.length, r.content) for r in snapshot_files(spark, folders).collect()}
    want = {tuple(p.split("/", 1)): ("file", len(d), d.decode(errors="replace")) for p, d in entered().items()}
    assert got == {**want, ("one", "loop"): ("symlink", 0, None)}
    listed = {(r.scan_id, r.path): r.kind for r in snapshot_listing(spark, folders).collect()}
    assert set(listed) == set(got)
    assert {p for (s, p), kind in listed.items() if s == "one" and kind} == {
        ".github/ci.yml", "pkg/__init__.py", "pkg/deep/er/z.go", "big.js", "prod.ENV", "Dockerfile"}
    assert listed["one", "Dockerfile"] == "manifest" and listed["one", ".env"] is None


def test_snapshot_filters_reach_the_walk(spark, folders, capsys):
    files = snapshot_files(spark, folders, max_file_bytes=100, eligible=True).where("scan_id = 'one'")
    assert sorted(r.path for r in files.collect()) == [
        ".github/ci.yml", "Dockerfile", "pkg/__init__.py", "pkg/deep/er/z.go", "prod.ENV"]
    files.explain()
    plan = capsys.readouterr().out
    assert "(length" not in plan.split("BatchScan")[0]  # nothing is left for Spark to filter


def opened(monkeypatch, folders, filters, **options):
    """Names of the files a reader opens, and the rows it gives, all in this process."""
    names, plain = [], open
    monkeypatch.setattr("builtins.open", lambda path, *a: names.append(os.path.relpath(path, folders)) or plain(path, *a))
    reader = snapshot.SnapshotReader({"path": folders, **options})
    left = list(reader.pushFilters(filters))
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    monkeypatch.undo()
    return sorted(names), rows, parts, left


def test_only_wanted_files_are_opened(monkeypatch, folders):
    names, rows, parts, _ = opened(monkeypatch, folders, [])
    assert names == sorted(entered())  # ignored folders and links stay closed
    assert len(parts) == 7  # one, its pkg, deep and er, its .github, two, two's pkg
    assert opened(monkeypatch, folders, [], splitbelow="0")[1:3] != (rows, parts)
    wanted = [snapshot.IsNotNull(("kind",)), snapshot.LessThanOrEqual(("length",), 100),
              snapshot.EqualTo(("scan_id",), "one")]
    other = snapshot.EqualTo(("content",), "x")
    names, rows, _, left = opened(monkeypatch, folders, [*wanted, other])
    assert names == ["one/.github/ci.yml", "one/Dockerfile", "one/pkg/__init__.py", "one/pkg/deep/er/z.go", "one/prod.ENV"]
    assert len(rows) == 5 and left == [other]
    names, rows, _, _ = opened(monkeypatch, folders, [], contents="false")
    assert names == [] and len(rows) == len(entered()) + 1
    for odd in ("../snapshots", "..", "", "three", "none"):
        assert opened(monkeypatch, folders, [snapshot.EqualTo(("scan_id",), odd)])[1] == []
    assert {r["scan_id"] for r in opened(monkeypatch, folders, [snapshot.In(("scan_id",), ("two", "none"))])[1]} == {"two"}


def test_split_and_whole_reading_give_the_same_rows(monkeypatch, folders):
    order = lambda rows: sorted(rows, key=lambda r: (r["scan_id"], r["path"]))
    fine = opened(monkeypatch, folders, [])[1]
    assert order(fine) == order(opened(monkeypatch, folders, [], splitbelow="0")[1])


def test_large_files_are_read_or_counted_as_skipped(spark, folders):
    scans = spark.createDataFrame([("one", False, False), ("two", False, False)],
                                  "scan_id string, history_available boolean, advisories_available boolean")
    empty = [spark.createDataFrame([], s) for s in (schemas.GIT_LOG, schemas.EXTERNAL_REPORTS, schemas.ADVISORIES)]

    def run(limits):
        result = scan_folders(spark, folders, scans, *empty, default_baselines(spark), limits)
        summary = {r.scan_id: (r.files_scanned, r.skipped_large_files, r.total_findings) for r in result.summary.collect()}
        return summary, {(r.file, r.rule) for r in result.stored.collect()}

    summary, found = run(Limits())
    assert summary == {"one": (6, 0, 2), "two": (1, 0, 0)}
    assert found == {("big.js", "SEC-EVAL"), ("pkg/deep/er/z.go", "SEC-EVAL")}
    summary, found = run(Limits(max_file_bytes=512_000))
    assert summary == {"one": (5, 1, 1), "two": (1, 0, 0)}
    assert found == {("pkg/deep/er/z.go", "SEC-EVAL")}


@pytest.mark.parametrize(
    ("url", "web", "reason"),
    [
        ("https://github.com/OWASP/NodeGoat.git", "https://github.com/OWASP/NodeGoat", None),
        (" HTTPS://GitHub.com:443/a/b?x#y ", "https://github.com/a/b", None),
        ("https://github.com/a/b/", "https://github.com/a/b", None),
        ("https://github.com/a/b.git/", "https://github.com/a/b.git", None),
        ("https://github.com/a/x/../b", "https://github.com/a/b", None),
        ("https://user@github.com/a/b", "https://github.com/a/b", None),
        ("https://example.com/org/repo", None, repositories.WRONG_HOST),
        ("http://github.com/org/repo", None, repositories.WRONG_HOST),
        ("ssh://git@github.com/a/b", None, repositories.WRONG_HOST),
        ("https://github.com/org/repo/issues", None, repositories.WRONG_PATH),
        ("https://github.com/org", None, repositories.WRONG_PATH),
        ("https://github.com/org/re po", None, repositories.WRONG_PATH),
        ("github.com/a/b", None, repositories.NOT_A_URL),
        ("", None, repositories.NOT_A_URL),
        (None, None, repositories.NOT_A_URL),
    ],
)
def test_repository_urls(spark, url, web, reason):
    row = repositories.parse_repository_urls(
        spark.createDataFrame([(url,)], "url string"), "url"
    ).first()
    assert (row.web_url, row.reject_reason) == (web, reason)


def test_admission(spark):
    rows = [("ok", 250_000, False), ("big", 250_001, True), ("old", 1, True), ("null", None, None)]
    repos = spark.createDataFrame(rows, "name string, size_kb long, archived boolean")
    names = lambda df: {r.name for r in df.collect()}
    assert names(repositories.admit_repositories(repos)) == {"ok", "null"}
    assert names(repositories.admit_repositories(repos, allow_archived=True)) == {
        "ok", "old", "null",
    }


def test_archive_guard_edges(spark):
    rows = [("s", 1, "a", "File", 5), ("s", 2, "b", "SymbolicLink", 5), ("t", 1, "a", "File", 11)]
    entries = spark.createDataFrame(rows, schemas.ARCHIVE_ENTRIES)
    kept = archives.guard_archive_entries(entries, max_entries=2, max_bytes=10).collect()
    assert [(r.scan_id, r.path) for r in kept] == [("s", "a")]
    assert archives.guard_archive_entries(entries, max_entries=1, max_bytes=99).count() == 1


def test_history_logs(spark, tmp_path):
    (tmp_path / "my scan.log").write_text("commit:a\n+x\ncommit:b\r\n+y\ncommit:c\n+z")
    rows = history_log.history_lines(spark, str(tmp_path), commits=2).orderBy("seq").collect()
    assert {r.scan_id for r in rows} == {"my scan"}
    assert [r.line for r in rows] == ["commit:a", "+x", "commit:b", "+y", ""]


def test_long_logs_are_read_in_ranges(spark, tmp_path):
    rnd = random.Random(3)
    words = ["commit:", "+x = 1", "", "\r", "file b/ä", "z" * 400, "\u2028q", " \r"]
    logs = {f"s{n}": "\n".join(rnd.choice(words) for _ in range(n)) for n in (1, 2, 3, 40, 900)}
    logs |= {"empty": "", "breaks": "\n\n", "ended": "a\r\nb\r\n", "bare": "a\nb\r", "one +%": "c"}
    for name, text in logs.items():
        (tmp_path / f"{name}.log").write_bytes(text.encode())
    want = sorted((n, i, x) for n, t in logs.items() if t for i, x in enumerate(re.split(r"\r?\n", t)))
    usual = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, size in zip(usual, ("2000", "100")):
            spark.conf.set(k, size)
        got = sorted(map(tuple, history_log.history_lines(spark, str(tmp_path)).collect()))
        tasks = spark.read.text(str(tmp_path / "s900.log")).rdd.getNumPartitions()
    finally:
        for k, size in usual.items():
            spark.conf.set(k, size)
    assert got == want and tasks > 10
    assert sorted(map(tuple, history_log.history_lines(spark, str(tmp_path)).collect())) == want


def test_bucketed_store(spark, tmp_path):
    day = datetime(2024, 3, 1, tzinfo=timezone.utc)
    schema = "scan_id string, created_at timestamp, score int"
    rows = [(f"s{i}", day, i) for i in range(200)] + [(None, day, -1)]
    held = store.BucketedStore(str(tmp_path / "t"), buckets=8)
    held.create(spark.createDataFrame(rows, schema))
    parts = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before = parts()
    come = spark.createDataFrame([("s7", day, 700), ("s7", day + timedelta(1), 701)], schema)
    held.upsert(come)
    after = parts()
    assert len({p.parent for p in set(before) ^ set(after)}) == 1  # one bucket changed, whole files
    assert all(after[p] == t for p, t in before.items() if p in after)
    held.upsert(come)
    held.upsert(come.limit(0))
    want = {r[0]: r[2] for r in rows} | {"s7": 701}
    assert {r.scan_id: r.score for r in held.scans(spark).collect()} == want
    assert held.scans(spark).count() == len(rows) and held.scans(spark).columns == schema_names(schema)
    found = held.find(spark, "s7")
    assert [r.score for r in found.collect()] == [701] and held.find(spark, "x").first() is None
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket_of_8" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    with pytest.raises(ValueError):
        store.BucketedStore(str(tmp_path / "t"), buckets=9).find(spark, "s7")


def schema_names(schema):
    return [part.split()[0] for part in schema.split(", ")]


def test_reports(spark):
    semgrep = {"results": [{"check_id": "c", "path": "a\\b.js", "extra": {}}, {"start": {"line": "12"}, "extra": {"fix": "f"}}]}
    osv = {"results": [{"packages": [{"vulnerabilities": [{"id": "X"}, {"id": "Y"}]}, {}]},
                       {"source": {"path": "p"}, "packages": [{"vulnerabilities": [{"id": "Z"}]}]}]}
    rows = [
        ("s", "Semgrep", json.dumps(semgrep)), ("s", "OSV-Scanner", json.dumps(osv)),
        ("s", "Gitleaks", json.dumps({"RuleID": "not an array"})), ("t", "Semgrep", "{"),
        ("t", "OSV-Scanner", json.dumps(osv) + " x"),
    ]
    given = spark.createDataFrame(rows, schemas.EXTERNAL_REPORTS)
    found = reports.external_findings(given)
    got = {r.id: r for r in found.collect()}
    assert set(got) == {"SEMGREP-0-c", "SEMGREP-1-undefined", "OSV-X-0", "OSV-Y-1", "OSV-Z-2"}
    first = got["SEMGREP-0-c"]
    assert (first.file, first.line, first.severity, first.title) == ("a/b.js", 1, "medium", "c")
    assert first.evidence == reports.DEFAULT_EVIDENCE and first.fingerprint is None
    assert got["SEMGREP-1-undefined"].patch == ["f"]
    assert got["SEMGREP-1-undefined"].line == 12
    assert got["OSV-Z-2"].file == "p" and got["OSV-X-0"].evidence == "package unknown version"
    status = {
        (r.scan_id, r.tool): (r.available, r.finding_count)
        for r in reports.external_tool_status(given, found).collect()
    }
    assert status[("s", "Gitleaks")] == (True, 0) and status[("t", "Semgrep")] == (True, 0)
    assert status[("t", "Gitleaks")] == (False, 0) and status[("s", "OSV-Scanner")] == (True, 3)


def test_advisories(spark, tmp_path):
    reply = {"vulns": [{"id": "A", "database_specific": {"severity": "LOW"}}]}
    replies = spark.createDataFrame(
        [("npm", "n", "1", json.dumps(reply)), ("npm", "m", "1", "{}")],
        "ecosystem string, name string, version string, reply string",
    )
    table = advisories_from_replies(replies)
    table.write.parquet(str(tmp_path / "adv"))
    row = advisories(spark, str(tmp_path / "adv")).collect()
    assert [(r.name, r.id, r.severity) for r in row] == [("n", "A", "LOW")]


def test_store(spark, tmp_path):
    now = datetime(2024, 3, 1, tzinfo=timezone.utc)
    at = lambda **d: now - timedelta(**d)
    schema = "scan_id string, created_at timestamp, score int"
    old = spark.createDataFrame([("a", at(days=30), 1), ("b", at(days=30, seconds=1), 2)], schema)
    new = spark.createDataFrame([("a", at(days=1), 3), ("c", at(days=2), 4)], schema)
    merged = store.upsert_scans(old, new)
    assert {(r.scan_id, r.score) for r in merged.collect()} == {("a", 3), ("b", 2), ("c", 4)}
    assert [r.scan_id for r in store.retain_scans(old, now).collect()] == ["a"]
    kept = store.retain_scans(merged, now, limit=1).collect()
    assert [r.scan_id for r in kept] == ["a"]
    store.write_version(merged, str(tmp_path / "t"), 3)
    store.write_version(merged, str(tmp_path / "t"), 3)
    again = store.read_version(spark, str(tmp_path / "t"), 3)
    assert again.count() == 3
    plan = store.get_scan(again, "b")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(scan_id,b)" in plan
    assert store.get_scan(again, "zz").first() is None
