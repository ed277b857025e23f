"""Domain tables derived from the given tables, row by row, so that they grow with them."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.session import shared_folder

# Text blocks that hit exactly one rule each, by doc_id % 16.
# Key-like strings are put together here so that this file holds none.
SEEDS = (
    "const out = eval(payload);",
    'exec("ls " + req.query.dir);',
    "db.users.findOne({ name: req.body.name });",
    "node.innerHTML = location.hash;",
    "const o = { rejectUnauthorized: false };",
    "const a = req.body.cmd;\nspawn(a);",
    "const q = req.query.id;\nconn.execute(q);",
    "subprocess.run(\n    cmd,\n    shell=True)",
    "<div dangerouslySetInnerHTML={{ __html: content }} />",
    "key_id = AKIA" + "EXAMPLE000000000",
    "-----BEGIN RSA " + "PRIVATE KEY-----",
    'password = "' + 'example-only-000001"',
)
EXTENSIONS = (".js", ".py", ".env", ".md")
MANIFESTS = (
    "package-lock.json", "composer.lock", "requirements.txt", "go.sum", "Gemfile.lock",
    "Cargo.lock",
)
JOB_STATUS = {
    "signup": "queued", "view": "running", "click": "running",
    "purchase": "complete", "error": "failed",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Narrow seed rows over all cores before they grow into texts.

    Only for an input of fewer splits than cores, such as the small test tables.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _utc(col: str) -> Column:
    """The zone-less times of the given tables as instants, whatever the session zone."""
    return F.to_timestamp(F.concat(F.col(col).cast("string"), F.lit("Z")))


def _doc_scan(prefix: str = "") -> Column:
    """Snapshot of a document; a new one begins every 20 000 documents."""
    chunk = F.floor(F.col("doc_id") / 20_000)
    return _text(prefix, F.col("lang"), "-", F.col("source"), "-", chunk.cast("string"))


def _doc_path() -> Column:
    doc = F.col("doc_id")
    folder = F.when(doc % 13 == 0, "vendor/").when(doc % 17 == 5, ".github/").otherwise("")
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.floor(doc / 16) % 4).cast("int"))
    return _text(folder, F.col("source"), "/", doc.cast("string"), ext)


def _code_files(docs: DataFrame, prefix: str, seed: Column, folder: Column) -> DataFrame:
    blocks = F.array(*[F.lit("\n" + s) for s in SEEDS])
    content = _text(F.col("text"), F.coalesce(F.get(blocks, seed.cast("int")), F.lit("")))
    return docs.select(
        _doc_scan(prefix).alias("scan_id"),
        F.concat(folder, _doc_path()).alias("path"),
        F.when(F.col("doc_id") % 29 == 7, "symlink").otherwise("file").alias("entry_type"),
        F.octet_length(content).cast("long").alias("length"),
        content.alias("content"),
    )


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    return _code_files(table(spark, sf, "documents"), "", F.col("doc_id") % 16, F.lit(""))


def snapshot_folders(spark: SparkSession, sf: str) -> str:
    """The code files written as folders of real files and links, by the tasks, below the shared
    folder; a file that is written again gets the same bytes."""
    root = re.sub("^file:/*", "/", shared_folder(spark, "snapshots"))

    def write(batches):
        for batch in batches:
            for row in batch.to_pylist():
                target = os.path.join(root, row["scan_id"], row["path"])
                os.makedirs(os.path.dirname(target), exist_ok=True)
                if row["entry_type"] == "symlink":
                    if not os.path.lexists(target):
                        os.symlink(root, target)
                    continue
                with open(f"{target}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(row["content"].encode())
                os.replace(f.name, target)
            yield batch.slice(0, 0).select(["path"])

    code_files(spark, sf).mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
    return root


def code_files_prev(spark: SparkSession, sf: str) -> DataFrame:
    """The earlier state: some files in another folder, some with another finding."""
    doc = F.col("doc_id")
    shifted = (doc + F.when(doc % 7 == 0, 1).otherwise(0)) % 16
    folder = F.when(doc % 5 == 0, "old/").otherwise("")
    return _code_files(table(spark, sf, "documents"), "prev-", shifted, folder)


def html_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        _text("pages-", F.floor(F.col("page_id") / 500).cast("string")).alias("scan_id"),
        _text(F.col("page_id").cast("string"), ".html").alias("path"),
        F.lit("file").alias("entry_type"),
        F.octet_length("html").cast("long").alias("length"),
        F.col("html").alias("content"),
    )


def git_log(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as added lines; not every one brings its own commit and file mark."""
    doc = F.col("doc_id")
    code = table(spark, sf, "documents").select(
        "doc_id",
        _doc_scan().alias("scan_id"),
        _doc_path().alias("path"),
        _text(
            F.col("text"),
            F.coalesce(
                F.get(F.array(*[F.lit("\n" + s) for s in SEEDS]), (doc % 16).cast("int")),
                F.lit(""),
            ),
        ).alias("content"),
    )
    head = F.array(
        F.when(doc % 3 == 0, _text("commit:", F.sha2(doc.cast("string"), 256))).otherwise(
            "index 000..111"
        ),
        F.when(doc % 4 == 1, "+++ /dev/null").otherwise(_text("+++ b/", F.col("path"))),
    )
    body = F.transform(F.split("content", "\n", -1), lambda x: F.concat(F.lit("+"), x))
    return code.select("scan_id", "doc_id", F.posexplode(F.concat(head, body))).select(
        "scan_id",
        (F.col("doc_id") * 100_000 + F.col("pos")).alias("seq"),
        F.col("col").alias("line"),
    )


def _dependencies() -> Column:
    """Array of (name, version) of an order; about a third list ``core-lib`` first."""
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    minor = (order % 4).cast("string")
    version = F.when(order % 9 == 4, _text("1.", minor, ".1-rc1")).otherwise(
        _text("1.", minor, ".0")
    )
    return F.transform(
        F.sequence(F.lit(0).cast("long"), order % 6),
        lambda i: F.struct(
            F.when((order % 3 == 0) & (i == 0), "core-lib")
            .otherwise(F.concat(F.lit("pkg-"), ((cust * 7 + i * 131) % 4000).cast("string")))
            .alias("name"),
            version.alias("version"),
        ),
    )


def _lock_text(deps: Column) -> Column:
    join = lambda sep, f: F.array_join(F.transform(deps, f), sep)
    n, v = (lambda d: d["name"]), (lambda d: d["version"])
    npm = _text(
        '{"lockfileVersion": 3, "packages": {"": {"version": "9.9.9"}, ',
        join(", ", lambda d: _text('"node_modules/', n(d), '": {"version": "', v(d), '"}')),
        "}}",
    )
    composer = _text(
        '{"packages": [',
        join(", ", lambda d: _text('{"name": "', n(d), '", "version": "v', v(d), '"}')),
        "]}",
    )
    pip = _text(
        "# pinned\n", join("\n", lambda d: _text(n(d), "==", v(d), " ; marker")), "\nother>=2\n"
    )
    go = join(
        "\n",
        lambda d: _text(n(d), " v", v(d), " h1:aa=\n", n(d), " v", v(d), "/go.mod h1:bb="),
    )
    gem = _text(
        "GEM\n  specs:\n", join("\n", lambda d: _text("    ", n(d), " (", v(d), ")\n      x (1)"))
    )
    cargo = _text(
        "version = 3\n",
        join(
            "\n",
            lambda d: _text('[[package]]\nname = "', n(d), '"\nversion = "', v(d), '"\n'),
        ),
    )
    kind = F.col("_kind")
    return (
        F.when(kind == 0, npm).when(kind == 1, composer).when(kind == 2, pip)
        .when(kind == 3, go).when(kind == 4, gem).otherwise(cargo)
    )


def lock_files(spark: SparkSession, sf: str) -> DataFrame:
    """One lock file per order, in six formats; some JSON ones are cut short."""
    orders = _spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    staged = orders.withColumn("_deps", _dependencies()).withColumn(
        "_kind", (F.floor(F.col("o_orderkey") / 7) % 6).cast("int")
    )
    content = _lock_text(F.col("_deps"))
    broken = (F.col("o_orderkey") % 10 == 9) & (F.col("_kind") <= 1)
    names = F.array(*[F.lit(m) for m in MANIFESTS])
    text = staged.withColumn("_content", content).select(
        _text("cust-", F.col("o_custkey").cast("string")).alias("scan_id"),
        _text(F.col("o_orderkey").cast("string"), "/", F.get(names, F.col("_kind"))).alias("path"),
        F.lit("file").alias("entry_type"),
        F.when(broken, F.substring("_content", 1, 40)).otherwise(F.col("_content")).alias("content"),
    )
    return text.withColumn("length", F.octet_length("content").cast("long"))


def baselines(spark: SparkSession, sf: str) -> DataFrame:
    """First safe version per part, and one for the dependency nearly all use."""
    part = table(spark, sf, "part").select(
        _text("pkg-", F.col("p_partkey").cast("string")).alias("name"),
        _text("1.", (F.col("p_size") % 7).cast("string"), ".0").alias("below"),
        F.when(F.col("p_size") < 25, "high").otherwise("medium").alias("severity"),
        _text("ADV-", F.col("p_partkey").cast("string")).alias("advisory"),
    )
    core = part.filter(F.col("advisory") == "ADV-1").select(
        F.lit("core-lib").alias("name"),
        F.lit("1.2.0").alias("below"),
        F.lit("high").alias("severity"),
        F.lit("ADV-CORE").alias("advisory"),
    )
    return part.unionByName(core)


def advisories(spark: SparkSession, sf: str) -> DataFrame:
    ecosystems = ("npm", "Packagist", "PyPI", "Go", "RubyGems", "crates.io")
    words = ("critical", "moderate", "low", "", "HIGH")
    part = table(spark, sf, "part").select("p_partkey", "p_size").withColumn(
        "ecosystem", F.explode(F.array(*[F.lit(e) for e in ecosystems]))
    )
    key = F.col("p_partkey").cast("string")
    rows = part.select(
        "ecosystem",
        _text("pkg-", key).alias("name"),
        _text("1.", (F.col("p_size") % 4).cast("string"), ".0").alias("version"),
        _text("ADV-", key).alias("id"),
        F.when(F.col("p_size") > 20, _text("Summary ", key)).otherwise("").alias("summary"),
        F.get(F.array(*[F.lit(w) for w in words]), (F.col("p_size") % 5).cast("int")).alias(
            "severity"
        ),
    )
    core = rows.filter(F.col("id") == "ADV-1").select(
        "ecosystem",
        F.lit("core-lib").alias("name"),
        F.lit("1.0.0").alias("version"),
        F.lit("ADV-CORE").alias("id"),
        F.lit("").alias("summary"),
        F.lit("critical").alias("severity"),
    )
    return rows.unionByName(core)


def advisory_replies(spark: SparkSession, sf: str) -> DataFrame:
    """The advisories as staged look-up replies; some dependencies have none."""
    found = F.struct(
        F.array(
            F.struct(
                "id", "summary", F.struct(F.col("severity")).alias("database_specific")
            )
        ).alias("vulns")
    )
    return advisories(spark, sf).select(
        "ecosystem",
        "name",
        "version",
        F.when(F.col("severity") == "low", "{}").otherwise(F.to_json(found)).alias("reply"),
    )


def repositories(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    path = _text(F.col("c_mktsegment"), "/r", key.cast("string"))
    kind = key % 8
    base = _text("https://github.com/", path)
    url = (
        F.when(kind == 0, base)
        .when(kind == 1, _text(base, ".git"))
        .when(kind == 2, _text(base, ".git/"))
        .when(kind == 3, _text("http://github.com/", path))
        .when(kind == 4, _text("https://example.com/", path))
        .when(kind == 5, _text(base, "/issues"))
        .when(kind == 6, _text("  HTTPS://GitHub.COM:443/", path, "?tab=readme#top "))
        .otherwise(F.when(key % 16 == 7, "").otherwise("not a url"))
    )
    return table(spark, sf, "customer").select(
        key.alias("repo_id"),
        url.alias("url"),
        (F.abs(F.col("c_acctbal")) * 50).cast("long").alias("size_kb"),
        (key % 11 == 0).alias("archived"),
    )


def archive_entries(spark: SparkSession, sf: str) -> DataFrame:
    types = ("File", "SymbolicLink", "Directory", "FIFO", "File", "File", "Link")
    kind = F.get(F.array(*[F.lit(t) for t in types]), (F.col("l_linenumber") % 7).cast("int"))
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("scan_id"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        kind.alias("entry_type"),
        F.col("l_extendedprice").cast("long").alias("size"),
    )


def snapshot_list(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of all the views, with what was available when they were scanned."""
    ids = (
        table(spark, sf, "documents").select(_doc_scan().alias("scan_id"))
        .union(
            table(spark, sf, "orders").select(_text("cust-", F.col("o_custkey").cast("string")))
        )
        .union(external_reports(spark, sf).select("scan_id"))
        .distinct()
    )
    is_doc = ~F.col("scan_id").startswith("cust-")
    number = F.substring_index("scan_id", "-", -1).cast("int")
    return ids.select(
        "scan_id",
        is_doc.alias("history_available"),
        (is_doc | (number % 3 != 0)).alias("advisories_available"),
    )


def scans(spark: SparkSession, sf: str) -> DataFrame:
    order = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        order.cast("string").alias("scan_id"),
        F.col("o_custkey").cast("string").alias("url"),
        _utc("o_orderdate").alias("created_at"),
        (F.col("o_totalprice").cast("long") % 101).cast("int").alias("score"),
        (order - 1 - F.col("o_custkey") % 5).cast("string").alias("previous_scan_id"),
    )


def order_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings stored for the scans above: one per order line."""
    rule = _text("R-", (F.col("l_partkey") % 20).cast("string"))
    file = _text("f", (F.col("l_suppkey") % 5).cast("string"), ".js")
    words = F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low")])
    tools = F.array(*[F.lit(s) for s in ("Source scan", "Secret scan", "Context scan")])
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("scan_id"),
        rule.alias("rule"),
        file.alias("file"),
        F.col("l_linenumber").alias("line"),
        F.get(words, (F.col("l_partkey") % 4).cast("int")).alias("severity"),
        F.get(tools, (F.col("l_suppkey") % 3).cast("int")).alias("tool"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit(None))
        .when(F.col("l_linenumber") % 3 == 1, "")
        .otherwise(F.sha2(_text(rule, ":", file), 256))
        .alias("fingerprint"),
    )


def review_events(spark: SparkSession, sf: str) -> DataFrame:
    return to_reviews(table(spark, sf, "events"))


def to_reviews(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    action = (
        F.when(kind.isin("click", "purchase"), "approve")
        .when(kind == "error", "reject")
        .otherwise("ignore")
    )
    user = F.col("user_id")
    return events.select(
        "event_id",
        _text("scan-", (user % 7).cast("string")).alias("scan_id"),
        _text("F-", user.cast("string")).alias("finding_id"),
        action.alias("action"),
        _utc("ts").alias("created_at"),
    )


def review_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings under review: per user one id that three findings share."""
    users = table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("_first"))
    user = F.col("user_id")
    rows = users.select(
        "user_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n")
    )
    severities = F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low")])
    return rows.select(
        _text("scan-", (user % 7).cast("string")).alias("scan_id"),
        F.struct(
            F.lit(0).alias("stage"),
            F.lpad(user.cast("string"), 12, "0").alias("walk"),
            F.lit(1).alias("phase"),
            F.col("n").cast("long").alias("n"),
            F.lit(0).alias("rule_ord"),
            F.lit("R").alias("rule"),
        ).alias("ord"),
        _text("F-", user.cast("string")).alias("id"),
        _text("R:f", user.cast("string"), ":", F.col("n").cast("string")).alias("finding_key"),
        F.get(severities, (user % 4).cast("int")).alias("severity"),
        _text("Title <", user.cast("string"), ">").alias("title"),
        F.lit("R").alias("rule"),
        _text("src/f", user.cast("string"), ".js").alias("file"),
        (F.col("n") + 1).alias("line"),
        F.lit("Why & how").alias("explanation"),
        _text("password = 'abc", user.cast("string"), "'\n\tcall(", user.cast("string"), ")")
        .alias("evidence"),
        F.array(F.lit("- old"), _text("+ new ", user.cast("string"))).alias("patch"),
        F.lit("open").alias("status"),
        F.lit(None).cast("string").alias("decision"),
        F.lit(None).cast("timestamp").alias("decided_at"),
        F.lit(None).cast("string").alias("ai_explanation"),
        F.when(user % 5 == 0, F.lit("pr")).alias("remediation_pull_request"),
    )


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Model replies with some markup for the user's finding, and older ones, now outdated."""
    users = table(spark, sf, "events").select("user_id").distinct()
    user = F.col("user_id")
    reply = (
        F.when(user % 3 == 0, _text("  <b>Fix</b> it\tnow ", user.cast("string"), "\x01 "))
        .when(user % 3 == 1, "<p></p>")
    )
    named = users.select(
        _text("scan-", (user % 7).cast("string")).alias("scan_id"),
        _text("F-", user.cast("string")).alias("finding_id"),
        F.lit("2024-02-02").cast("timestamp").alias("created_at"),
        reply.alias("reply"),
        user,
    )
    older = named.filter(user % 3 == 0).withColumns(
        {"created_at": F.lit("2024-02-01").cast("timestamp"), "reply": F.lit("outdated")}
    )
    return named.unionByName(older).drop("user_id")


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    return to_jobs(table(spark, sf, "events"))


def to_jobs(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    status = None
    for event, name in JOB_STATUS.items():
        status = F.when(kind == event, name) if status is None else status.when(kind == event, name)
    return events.select(
        "event_id",
        F.col("user_id").cast("string").alias("job_id"),
        status.alias("status"),
        F.floor(F.abs(F.col("value")) % 101).cast("int").alias("progress"),
        _text("phase\n", kind).alias("phase"),
        _utc("ts").alias("updated_at"),
    )


def request_events(spark: SparkSession, sf: str) -> DataFrame:
    return to_requests(table(spark, sf, "events"))


def to_requests(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.col("user_id").cast("string").alias("client"),
        F.when(F.col("event_type") == "signup", "scan").otherwise("api").alias("category"),
        _utc("ts").alias("ts"),
    )


def external_reports(spark: SparkSession, sf: str) -> DataFrame:
    """One report per conversation turn and tool, every tenth conversation cut short."""
    turn, conv = F.col("turn"), F.col("conv_id")
    n = F.sequence(F.lit(0).cast("long"), turn % 3)
    levels = F.array(*[F.lit(s) for s in ("ERROR", "WARNING", "INFO", "critical", "")])
    level = lambda i: F.get(levels, ((conv + i) % 5).cast("int"))
    s = lambda c: c.cast("string")
    semgrep = F.to_json(
        F.struct(
            F.transform(
                n,
                lambda i: F.struct(
                    F.concat(F.lit("rule."), F.col("role")).alias("check_id"),
                    F.concat(F.lit("src\\f"), s(i), F.lit(".js")).alias("path"),
                    F.struct((turn * 10 + i).alias("line")).alias("start"),
                    F.struct(
                        level(i).alias("severity"),
                        F.when(i != 1, F.col("text")).otherwise("").alias("message"),
                        F.when(i == 2, F.lit("fixed()")).alias("fix"),
                        F.col("text").alias("lines"),
                    ).alias("extra"),
                ),
            ).alias("results")
        )
    )
    gitleaks = F.to_json(
        F.transform(
            n,
            lambda i: F.struct(
                F.concat(F.lit("leak-"), s(i)).alias("RuleID"),
                F.when(i == 0, F.col("text")).alias("Description"),
                F.concat(F.lit("k"), s(i), F.lit(".env")).alias("File"),
                i.alias("StartLine"),
                F.when(i != 0, F.concat(F.lit("fp"), s(i))).alias("Fingerprint"),
            ),
        )
    )
    osv = F.to_json(
        F.struct(
            F.transform(
                n,
                lambda i: F.struct(
                    F.when(i != 1, F.struct(F.concat(F.lit("p"), s(i)).alias("path"))).alias(
                        "source"
                    ),
                    F.array(
                        F.struct(
                            F.struct(
                                F.concat(F.lit("lib"), s(i)).alias("name"),
                                F.when(i == 0, F.lit("2.0")).alias("version"),
                            ).alias("package"),
                            F.transform(
                                F.sequence(F.lit(0), F.lit(1)),
                                lambda j: F.struct(
                                    F.concat(F.lit("V-"), s(i), F.lit("-"), s(j)).alias("id"),
                                    F.when(j == 0, F.col("role")).alias("summary"),
                                    F.struct(level(i).alias("severity")).alias(
                                        "database_specific"
                                    ),
                                ),
                            ).alias("vulnerabilities"),
                        )
                    ).alias("packages"),
                ),
            ).alias("results")
        )
    )
    per_tool = F.array(
        F.struct(F.lit("Semgrep").alias("tool"), semgrep.alias("_full")),
        F.struct(F.lit("Gitleaks").alias("tool"), gitleaks.alias("_full")),
        F.struct(F.lit("OSV-Scanner").alias("tool"), osv.alias("_full")),
    )
    rows = table(spark, sf, "conversations").select(
        _text("cust-", s(conv * 16 + turn)).alias("scan_id"), "conv_id", F.inline(per_tool)
    )
    report = (
        F.when((F.col("conv_id") % 7 == 6) & (F.col("tool") == "Gitleaks"), F.lit(None))
        .when(F.col("conv_id") % 10 == 9, F.expr("substring(_full, 1, length(_full) - 2)"))
        .otherwise(F.col("_full"))
    )
    return rows.select("scan_id", "tool", report.alias("report"))
