"""The same domain tables and operators in DuckDB SQL, written independently of the Spark form."""

from __future__ import annotations

import re

from auditloom.functions.text import WS
from auditloom.operators.dependencies import ADVISORY_PATCH
from auditloom.rules import RULES, SECRET_TOOL
from auditloom.sources import reports as rep
from workload.views import EXTENSIONS, JOB_STATUS, MANIFESTS, SEEDS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def stable(x: str) -> str:
    return (
        f"substr(trim(regexp_replace(regexp_replace({x}, '[{WS}]+', ' ', 'g'), "
        r"'\b[0-9]+\b', '#', 'g')), 1, 300)"
    )


def fingerprint(rule: str, file: str, ev: str) -> str:
    return f"substr(sha256({rule} || ':' || replace({file}, '\\', '/') || ':' || {stable(ev)}), 1, 24)"


def redact(x: str) -> str:
    pattern = lit("""(["'])([^"']{6})[^"']+(["'])""")
    return f"substr(regexp_replace({x}, {pattern}, '\\1\\2…redacted…\\3', 'g'), 1, 260)"


def tail(x: str, n: int) -> str:
    return f"lower(right(hex({x}), {n}))"


_RULES = ",\n".join(
    f"({r.ord}, {lit(r.id)}, {lit(r.tool)}, {lit(r.scope)}, {lit(r.severity)}, {lit(r.title)}, "
    f"{lit(r.re2_pattern())}, {lit(r.explanation)}, {lit(chr(10).join(r.patch))})"
    for r in RULES
)
_IGNORED = strings((".git", "node_modules", "vendor", "coverage", ".next", "build", "dist"))
_EXT = strings(
    ".js .jsx .ts .tsx .mjs .cjs .json .yml .yaml .env .py .go .java .rb .php .html .vue "
    ".svelte".split()
)
_NAMES = strings(
    "Dockerfile Gemfile Gemfile.lock package-lock.json requirements.txt go.sum composer.lock "
    "Cargo.lock".split()
)
_ECO = strings(("npm", "Packagist", "PyPI", "Go", "RubyGems", "crates.io"))
WEIGHT = "CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 14 WHEN 'medium' THEN 7 ELSE 2 END"
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
LEVEL = (
    "CASE WHEN severity IN ('critical', 'high') THEN 'error' "
    "WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"
)


def _code(prefix: str, seed: str, folder: str) -> str:
    return f"""SELECT {lit(prefix)} || scan_id AS scan_id, {folder} || path AS path,
      CASE WHEN doc_id % 29 = 7 THEN 'symlink' ELSE 'file' END AS entry_type,
      strlen(body) AS length, body AS content
    FROM (SELECT *, text || coalesce({strings(chr(10) + s for s in SEEDS)}[{seed} + 1], '') AS body
          FROM docs) b"""


def _norm(x: str) -> str:
    return (
        f"CASE WHEN lower(coalesce(nullif({x}, ''), 'medium')) IN ('critical','high','medium','low') "
        f"THEN lower(coalesce(nullif({x}, ''), 'medium')) WHEN lower({x}) = 'error' THEN 'high' "
        f"WHEN lower({x}) = 'warning' THEN 'medium' ELSE 'low' END"
    )


_LEVEL_OF = "['ERROR','WARNING','INFO','critical',''][(conv_id + i) % 5 + 1]"

CTES: dict[str, str] = {
    "docs": f"""SELECT *, lang || '-' || source || '-' || (doc_id // 20000) AS scan_id,
      (CASE WHEN doc_id % 13 = 0 THEN 'vendor/' WHEN doc_id % 17 = 5 THEN '.github/' ELSE '' END)
        || source || '/' || doc_id || {strings(EXTENSIONS)}[(doc_id // 16) % 4 + 1] AS path
      FROM documents""",
    "code_files": _code("", "(doc_id % 16)", "''"),
    "code_files_prev": _code(
        "prev-",
        "((doc_id + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) % 16)",
        "CASE WHEN doc_id % 5 = 0 THEN 'old/' ELSE '' END",
    ),
    "html_files": """SELECT 'pages-' || (page_id // 500) AS scan_id, page_id || '.html' AS path,
      'file' AS entry_type, strlen(html) AS length, html AS content FROM pages""",
    "deps": """SELECT o_orderkey, 'cust-' || o_custkey AS scan_id, (o_orderkey // 7) % 6 AS kind, i AS pos,
        CASE WHEN o_orderkey % 3 = 0 AND i = 0 THEN 'core-lib'
             ELSE 'pkg-' || ((o_custkey * 7 + i * 131) % 4000) END AS name,
        '1.' || (o_orderkey % 4) || CASE WHEN o_orderkey % 9 = 4 THEN '.1-rc1' ELSE '.0' END AS version,
        (o_orderkey % 4)::INT AS minor
      FROM (SELECT *, unnest(range(0, o_orderkey % 6 + 1)) AS i FROM orders) o
      WHERE NOT (o_orderkey % 10 = 9 AND (o_orderkey // 7) % 6 <= 1)""",
    "inventory": f"""SELECT scan_id, o_orderkey || '/' || {strings(MANIFESTS)}[kind + 1] AS file,
        {_ECO}[kind + 1] AS ecosystem, name, version, minor, pos::INT AS pos FROM deps""",
    "core_baselines": """SELECT 'pkg-' || p_partkey AS name, p_size % 7 AS minor_below,
        CASE WHEN p_size < 25 THEN 'high' ELSE 'medium' END AS severity, 'ADV-' || p_partkey AS advisory
      FROM part UNION ALL SELECT 'core-lib', 2, 'high', 'ADV-CORE' FROM part WHERE p_partkey = 1""",
    "adv": f"""SELECT ecosystem, 'pkg-' || p_partkey AS name, '1.' || (p_size % 4) || '.0' AS version,
        'ADV-' || p_partkey AS id, CASE WHEN p_size > 20 THEN 'Summary ' || p_partkey ELSE '' END AS summary,
        ['critical','moderate','low','','HIGH'][p_size % 5 + 1] AS word
      FROM part, (SELECT unnest({_ECO}) AS ecosystem) e
      UNION ALL SELECT unnest({_ECO}), 'core-lib', '1.0.0', 'ADV-CORE', '', 'critical'
      FROM part WHERE p_partkey = 1""",
    "git": f"""SELECT scan_id, doc_id * 100000 + idx - 1 AS seq, line FROM (
        SELECT scan_id, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS idx FROM (
          SELECT d.scan_id, d.doc_id, list_concat([
            CASE WHEN d.doc_id % 3 = 0 THEN 'commit:' || sha256(d.doc_id::VARCHAR) ELSE 'index 000..111' END,
            CASE WHEN d.doc_id % 4 = 1 THEN '+++ /dev/null' ELSE '+++ b/' || d.path END],
            list_transform(string_split(d.text || coalesce({strings(chr(10) + s for s in SEEDS)}[d.doc_id % 16 + 1], ''), chr(10)),
              lambda x: '+' || x)) AS ls FROM docs d) a) b""",
    "filled": """SELECT scan_id, seq, line,
        coalesce(last_value(c IGNORE NULLS) OVER w, 'unknown') AS commit,
        coalesce(last_value(f IGNORE NULLS) OVER w, 'git-history') AS file
      FROM (SELECT *, CASE WHEN starts_with(line, 'commit:') THEN substr(line, 8, 12) END AS c,
                   CASE WHEN starts_with(line, '+++ b/') THEN substr(line, 7) END AS f FROM git) g
      WINDOW w AS (PARTITION BY scan_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "rules": f"""SELECT * FROM (VALUES {_RULES})
        t(rule_ord, rule, tool, scope, severity, title, pattern, explanation, patch)""",
    "all_files": """SELECT * FROM code_files""",
    "eligible": f"""SELECT * FROM code_files WHERE entry_type = 'file'
        AND NOT list_has_any(string_split(path, '/')[1:-2], {_IGNORED})
        AND (list_contains({_EXT}, lower(regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]*)$', 1)))
             OR list_contains({_NAMES}, string_split(path, '/')[-1]))""",
    "walked": """SELECT scan_id, path, length,
        row_number() OVER (PARTITION BY scan_id ORDER BY string_split(path, '/'))::INT AS file_ord FROM eligible""",
    "budgeted": """SELECT *, coalesce(sum(CASE WHEN length <= 8000 THEN length END)
          OVER (PARTITION BY scan_id ORDER BY file_ord), 0)::BIGINT AS running_bytes
        FROM walked WHERE file_ord <= 6""",
    "volume": """SELECT scan_id,
        count(*) FILTER (length <= 8000 AND running_bytes <= 20000) AS files_scanned,
        coalesce(sum(length) FILTER (length <= 8000 AND running_bytes <= 20000), 0)::BIGINT AS bytes_scanned,
        count(*) FILTER (length > 8000 AND running_bytes <= 20000) AS skipped_large_files,
        bool_or(running_bytes > 20000) AS over, count(*) >= 6 AS full_list
      FROM budgeted GROUP BY scan_id""",
    "src_lines": """SELECT scan_id, path, unnest(ls) AS text, generate_subscripts(ls, 1)::INT AS line_no
      FROM (SELECT scan_id, path, regexp_split_to_array(content, '\\r?\\n') AS ls FROM eligible) e""",
    "src_windows": """SELECT scan_id, path, array_to_string(ls[i + 1 : i + 8], chr(10)) AS text, (i + 1)::INT AS line_no
      FROM (SELECT *, unnest(range(0, len(ls), 4)) AS i FROM
        (SELECT scan_id, path, regexp_split_to_array(content, '\\r?\\n') AS ls FROM eligible) e) w""",
    "hits": """SELECT u.*, r.* EXCLUDE (pattern, scope) FROM
        (SELECT *, 1 AS phase, 'line' AS unit FROM src_lines
         UNION ALL SELECT *, 2, 'window' FROM src_windows) u
        JOIN rules r ON r.scope = u.unit AND regexp_matches(u.text, r.pattern)""",
    "rule_findings": f"""SELECT scan_id, 0 AS stage, string_split(path, '/') AS walk, phase, line_no::BIGINT AS n, rule_ord,
        rule || '-' || {tail("path || ':' || line_no", 8)} AS id, severity, title, tool, rule, path AS file,
        line_no AS line, explanation,
        CASE WHEN tool = {lit(SECRET_TOOL)} THEN {redact(trim('text'))} ELSE substr({trim('text')}, 1, 500) END AS evidence,
        patch, NULL::VARCHAR AS commit, {fingerprint('rule', 'path', 'text')} AS fingerprint FROM hits""",
    "history_hits": """SELECT f.*, r.* EXCLUDE (pattern, scope) FROM filled f JOIN rules r
        ON r.tool = 'Secret scan' AND starts_with(f.line, '+') AND NOT starts_with(f.line, '+++')
        AND regexp_matches(f.line, r.pattern)""",
    "history_findings": f"""SELECT scan_id, 1 AS stage, [''] AS walk, 0 AS phase, seq AS n, rule_ord,
        rule || '-HISTORY-' || {tail("commit || ':' || file", 10)} AS id, severity, title, 'Git history' AS tool,
        rule, file, 1 AS line, explanation, {redact(trim('line'))} AS evidence, patch, commit,
        {fingerprint('rule', 'file', 'line')} AS fingerprint FROM history_hits h""",
    "advisory_rows": f"""SELECT i.scan_id, i.file, i.pos, a.id AS rule,
        CASE lower(word) WHEN 'critical' THEN 'critical' WHEN 'moderate' THEN 'medium' WHEN 'medium' THEN 'medium'
             ELSE 'high' END AS severity, a.id || ' affects ' || i.name AS title,
        coalesce(nullif(summary, ''), i.name || ' ' || i.version || ' is affected by a published OSV advisory.') AS explanation,
        i.ecosystem || ':' || i.name || ' ' || i.version AS ev, {lit(ADVISORY_PATCH)} AS patch, i.ecosystem
      FROM inventory i JOIN adv a USING (ecosystem, name, version)""",
    "baseline_rows": """SELECT i.scan_id, i.file, i.pos, 'DEP-' || upper(i.name) AS rule, b.severity,
        'Vulnerable ' || i.name || ' dependency' AS title,
        i.name || ' ' || i.version || ' is below the patched baseline 1.' || minor_below || '.0 (' || advisory ||
          '). Upgrade it and run the project test suite.' AS explanation,
        '"' || i.name || '": "' || i.version || '"' AS ev,
        '- "' || i.name || '": "' || i.version || '"' || chr(10) || '+ "' || i.name || '": "1.' || minor_below ||
          '.0" or newer' AS patch, i.ecosystem
      FROM inventory i JOIN core_baselines b ON i.name = b.name AND i.minor < b.minor_below""",
    "advisory_findings": "",
    "baseline_findings": "",
    "fallback_findings": """SELECT f.* FROM advisory_findings f WHERE split_part(scan_id, '-', 2)::INT % 3 <> 0
      UNION ALL SELECT f.* FROM baseline_findings f
      WHERE split_part(scan_id, '-', 2)::INT % 3 = 0 AND ends_with(file, '/package-lock.json')""",
    "own": """SELECT * FROM rule_findings UNION ALL SELECT * FROM history_findings""",
    "deduped": """SELECT l.* EXCLUDE (stage, walk, phase, n, rule_ord, last_no, first_no),
        f.stage, f.walk, f.phase, f.n, f.rule_ord FROM
        (SELECT *, row_number() OVER (PARTITION BY scan_id, rule, file, line
            ORDER BY stage DESC, walk DESC, phase DESC, n DESC, rule_ord DESC) AS last_no, 0 AS first_no FROM own) l
        JOIN (SELECT *, row_number() OVER (PARTITION BY scan_id, rule, file, line
            ORDER BY stage, walk, phase, n, rule_ord) AS no FROM own) f
        ON l.last_no = 1 AND f.no = 1 AND l.scan_id = f.scan_id AND l.rule = f.rule AND l.file = f.file
           AND l.line = f.line""",
    "doc_scans": "SELECT DISTINCT scan_id FROM docs",
    "conv": "SELECT *, 'cust-' || (conv_id * 16 + turn) AS scan_id FROM conversations",
    "conv_items": "SELECT *, unnest(range(0, turn % 3 + 1)) AS i FROM conv WHERE conv_id % 10 <> 9",
    "semgrep": f"""SELECT scan_id, 2 AS stage, [''] AS walk, 0 AS phase, i AS n,
        'SEMGREP-' || i || '-rule.' || role AS id, {_norm(_LEVEL_OF)} AS severity,
        CASE WHEN i <> 1 AND text <> '' THEN text ELSE 'rule.' || role END AS title, 'Semgrep' AS tool,
        'rule.' || role AS rule, 'src/f' || i || '.js' AS file,
        CASE WHEN turn * 10 + i = 0 THEN 1 ELSE turn * 10 + i END::INT AS line,
        CASE WHEN i <> 1 AND text <> '' THEN text ELSE {lit(rep.SEMGREP_EXPLANATION)} END AS explanation,
        CASE WHEN text = '' THEN {lit(rep.DEFAULT_EVIDENCE)} ELSE substr(text, 1, 500) END AS evidence,
        CASE WHEN i = 2 THEN 'fixed()' ELSE {lit(rep.DEFAULT_PATCH[0])} END AS patch FROM conv_items c""",
    "gitleaks": f"""SELECT scan_id, 2 AS stage, [''] AS walk, 1 AS phase, i AS n,
        'GITLEAKS-' || i || '-leak-' || i AS id, 'critical' AS severity,
        CASE WHEN i = 0 AND text <> '' THEN text ELSE {lit(rep.GITLEAKS_TITLE)} END AS title, 'Gitleaks' AS tool,
        'leak-' || i AS rule, 'k' || i || '.env' AS file, CASE WHEN i = 0 THEN 1 ELSE i END::INT AS line,
        {lit(rep.GITLEAKS_EXPLANATION)} AS explanation,
        'Fingerprint: ' || CASE WHEN i = 0 THEN 'redacted' ELSE 'fp' || i END AS evidence,
        {lit(chr(10).join(rep.GITLEAKS_PATCH))} AS patch FROM conv_items c WHERE conv_id % 7 <> 6""",
    "osv_scanner": f"""SELECT scan_id, 2 AS stage, [''] AS walk, 2 AS phase, i * 2 + j AS n,
        'OSV-V-' || i || '-' || j || '-' || (i * 2 + j) AS id,
        CASE {_LEVEL_OF} WHEN 'ERROR' THEN 'high' WHEN 'WARNING' THEN 'medium' WHEN 'INFO' THEN 'low'
             WHEN 'critical' THEN 'critical' ELSE 'high' END AS severity,
        'V-' || i || '-' || j || ' affects lib' || i AS title, 'OSV-Scanner' AS tool, 'V-' || i || '-' || j AS rule,
        CASE WHEN i = 1 THEN 'dependency manifest' ELSE 'p' || i END AS file, 1 AS line,
        CASE WHEN j = 0 AND role <> '' THEN role ELSE {lit(rep.OSV_EXPLANATION)} END AS explanation,
        'lib' || i || ' ' || CASE WHEN i = 0 THEN '2.0' ELSE 'unknown version' END AS evidence,
        {lit(rep.OSV_PATCH[0])} AS patch FROM (SELECT *, unnest([0, 1]) AS j FROM conv_items) c""",
    "external": """SELECT * FROM semgrep UNION ALL SELECT * FROM gitleaks UNION ALL SELECT * FROM osv_scanner""",
    "tool_status": """SELECT c.scan_id, t.tool, NOT (conv_id % 7 = 6 AND t.tool = 'Gitleaks') AS available,
        coalesce(e.n, 0)::INT AS finding_count
      FROM conv c CROSS JOIN (SELECT unnest(['Semgrep', 'Gitleaks', 'OSV-Scanner']) AS tool) t
      LEFT JOIN (SELECT scan_id, tool, count(*) AS n FROM external GROUP BY ALL) e
        ON e.scan_id = c.scan_id AND e.tool = t.tool""",
    "everything": """SELECT scan_id, stage, walk, phase, n, rule_ord, severity, tool, rule, file, line, fingerprint FROM own
      UNION ALL SELECT scan_id, stage, walk, phase, n, rule_ord, severity, tool, rule, file, line, fingerprint
      FROM fallback_findings""",
    "everything_deduped": """SELECT scan_id, rule, file, line,
        arg_max(severity, o) AS severity, arg_max(tool, o) AS tool, min(o) AS o, arg_max(fingerprint, o) AS fingerprint
      FROM (SELECT *, {'a': stage, 'b': walk, 'c': phase, 'd': n, 'e': rule_ord, 'f': rule} AS o FROM everything) x
      GROUP BY scan_id, rule, file, line""",
    "final_findings": """SELECT scan_id, rule, file, line, severity, tool, o FROM everything_deduped
      UNION ALL SELECT scan_id, rule, file, line, severity, tool,
        {'a': stage, 'b': walk, 'c': phase, 'd': n, 'e': 0, 'f': rule} FROM external""",
    "snapshot_list": """SELECT scan_id, true AS doc FROM doc_scans
      UNION ALL SELECT DISTINCT 'cust-' || o_custkey, false FROM orders
      UNION ALL SELECT c.scan_id, false FROM conv c WHERE conv_id * 16 + turn NOT IN (SELECT o_custkey FROM orders)""",
    "scans_v": """SELECT o_orderkey::VARCHAR AS scan_id, o_custkey::VARCHAR AS url, o_orderdate AS created_at,
        (trunc(o_totalprice)::BIGINT % 101)::INT AS score,
        (o_orderkey - 1 - o_custkey % 5)::VARCHAR AS previous_scan_id FROM orders""",
    "stored": """SELECT l_orderkey::VARCHAR AS scan_id, 'R-' || (l_partkey % 20) AS rule, 'f' || (l_suppkey % 5) || '.js' AS file,
        l_linenumber AS line, ['critical','high','medium','low'][l_partkey % 4 + 1] AS severity,
        ['Source scan','Secret scan','Context scan'][l_suppkey % 3 + 1] AS tool,
        CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN ''
             ELSE sha256('R-' || (l_partkey % 20) || ':' || 'f' || (l_suppkey % 5) || '.js') END AS fingerprint
      FROM lineitem""",
    "keyed": """SELECT *, CASE WHEN fingerprint IS NULL OR fingerprint = '' THEN rule || ':' || file || ':' || line
        ELSE fingerprint END AS key FROM stored""",
    "pairs": """SELECT c.scan_id, c.previous_scan_id, c.score, p.score AS previous_score
      FROM scans_v c JOIN scans_v p ON p.scan_id = c.previous_scan_id""",
    "users": "SELECT DISTINCT user_id FROM events",
    "reviewed": """SELECT 'scan-' || (user_id % 7) AS scan_id, 'F-' || user_id AS finding_id, event_id, ts,
        CASE WHEN event_type IN ('click', 'purchase') THEN 'approve' WHEN event_type = 'error' THEN 'reject'
             ELSE 'ignore' END AS action FROM events""",
    "under_review": """SELECT 'scan-' || (user_id % 7) AS scan_id, 'F-' || user_id AS id, user_id, n,
        'R:f' || user_id || ':' || n AS finding_key, ['critical','high','medium','low'][user_id % 4 + 1] AS severity
      FROM users, (SELECT unnest([0, 1, 2]) AS n) k""",
    "decided": """SELECT scan_id, finding_id, arg_max(action, {'t': ts, 'e': event_id}) AS action, max(ts) AS decided_at
      FROM reviewed WHERE action IN ('approve', 'reject') GROUP BY ALL""",
    "after_review": """SELECT u.*, d.action AS decision, d.decided_at,
        CASE WHEN d.action = 'reject' THEN 'dismissed' WHEN d.action = 'approve' THEN 'approved' ELSE 'open' END AS status
      FROM under_review u LEFT JOIN decided d ON d.scan_id = u.scan_id AND d.finding_id = u.id AND u.n = 0""",
    "jobs": "SELECT event_id, user_id::VARCHAR AS job_id, CASE event_type "
    + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in JOB_STATUS.items())
    + " END AS status, floor(abs(value) % 101)::INT AS progress, 'phase' || chr(10) || event_type AS phase, ts FROM events",
    "job_now": """SELECT job_id, arg_max(status, {'t': ts, 'e': event_id}) AS status, arg_max(progress, {'t': ts, 'e': event_id}) AS progress,
        arg_max(phase, {'t': ts, 'e': event_id}) AS phase, max(ts) AS updated_at FROM jobs GROUP BY job_id""",
}


def _dependency(rows: str, tool: str) -> str:
    return f"""SELECT scan_id, 0 AS stage, string_split(file, '/') AS walk, 0 AS phase, pos::BIGINT AS n, 0 AS rule_ord,
      rule || '-' || {tail("file || ':1'", 8)} AS id, severity, title, {lit(tool)} AS tool, rule, file, 1 AS line,
      explanation, substr({trim('ev')}, 1, 500) AS evidence, patch, NULL::VARCHAR AS commit,
      {fingerprint('rule', 'file', 'ev')} AS fingerprint FROM {rows}"""


CTES["advisory_findings"] = _dependency("advisory_rows", "OSV.dev")
CTES["baseline_findings"] = _dependency("baseline_rows", "Dependency audit")


def with_ctes(final: str, extra: dict[str, str] | None = None) -> str:
    """The final query behind the tables it needs, each after the ones it uses."""
    table = {**CTES, **(extra or {})}
    ordered: list[str] = []

    def need(sql: str) -> None:
        for name in sorted(set(re.findall(r"\b[a-z_]+\b", sql)) & table.keys()):
            if name not in ordered and name not in open_names:
                open_names.add(name)
                need(table[name])
                ordered.append(name)

    open_names: set[str] = set()
    need(final)
    parts = [f"{n} AS (\n{table[n]}\n)" for n in ordered]
    head = "WITH RECURSIVE " if "walk" in ordered else "WITH "
    return (head + ",\n".join(parts) + "\n" + final) if parts else final
