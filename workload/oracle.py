"""DuckDB query per registered query."""

from __future__ import annotations

from auditloom.functions.prompts import INSTRUCTIONS
from auditloom.rules import RULES
from auditloom.sources import repositories as repo
from workload.queries import (
    ARCHIVE_BYTES,
    ARCHIVE_ENTRIES,
    BRANCH_PREFIX,
    RATE_LIMITS,
    RATE_WINDOW_MS,
    TOOL_NAME,
    TOP_K,
)
from workload.sql import CTES, LEVEL, RANK, WEIGHT, lit, trim, with_ctes

FLAT = "scan_id, id, severity, title, tool, rule, file, line, explanation, evidence, patch, fingerprint"
FLAT_EXT = FLAT.replace(", fingerprint", "")

_SUMMARY_TOTALS = f"""SELECT scan_id, count(*) AS total, count(*) FILTER (severity = 'critical') AS crit,
    count(*) FILTER (severity = 'high') AS high, sum({WEIGHT}) AS weight FROM final_findings GROUP BY scan_id"""


def _rank_rows(source: str, order: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {RANK}, {order}) AS position FROM {source}"""


_POS = "stage, walk, phase, n, rule_ord, rule"


def _side(current: str, other: str, anti: str) -> str:
    own, far = ("scan_id", "previous_scan_id") if current == "now" else ("previous_scan_id", "scan_id")
    return f"""SELECT p.scan_id AS pair, f.key, f.rule, f.file, f.line, f.severity
      FROM pairs p JOIN keyed f ON f.scan_id = p.{own}
      WHERE {anti} EXISTS (SELECT 1 FROM keyed o WHERE o.scan_id = p.{far} AND o.key = f.key)"""


_URL = """SELECT c_custkey, c_custkey % 8 AS k, c_mktsegment AS owner, 'r' || c_custkey AS name, c_acctbal FROM customer"""

_STORED = f"""SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {RANK}, {_POS}) AS position FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, rule, file, line ORDER BY {_POS}) AS dup
                   FROM rule_findings) x WHERE dup = 1) y"""


def oracles() -> dict[str, str]:
    q: dict[str, tuple[str, dict[str, str] | None]] = {}

    def add(name: str, final: str, extra: dict[str, str] | None = None) -> None:
        q[name] = (final, extra)

    add(
        "snapshot_source",
        "SELECT scan_id, path, length, sha256(content) AS content_sha FROM eligible WHERE length <= 8000",
    )
    add(
        "snapshot_listing",
        """SELECT scan_id, path, entry_type, CASE WHEN entry_type = 'file' THEN length END AS length FROM code_files
        WHERE NOT list_has_any(string_split(path, '/')[1:-2],
        ['.git','node_modules','vendor','coverage','.next','build','dist'])""",
    )
    add("eligible_files", "SELECT scan_id, path, length FROM eligible")
    add(
        "pruned_directories",
        """SELECT scan_id, path FROM code_files WHERE NOT list_has_any(string_split(path, '/')[1:-2],
        ['.git','node_modules','vendor','coverage','.next','build','dist'])""",
    )
    add("file_limit", "SELECT scan_id, path, file_ord FROM walked WHERE file_ord <= 6")
    add(
        "byte_budget",
        """SELECT scan_id, path, file_ord, running_bytes, length > 8000 AS is_large,
        length <= 8000 AND running_bytes <= 20000 AS taken FROM budgeted""",
    )
    add(
        "whole_budget",
        """SELECT scan_id, path, running_bytes, length > 8000 AS is_large,
        length <= 8000 AND running_bytes <= 20000 AS taken FROM (
          SELECT *, coalesce(sum(CASE WHEN length <= 8000 THEN length END)
            OVER (PARTITION BY scan_id ORDER BY file_ord), 0)::BIGINT AS running_bytes FROM walked)""",
    )
    add(
        "scan_volume",
        """SELECT scan_id, files_scanned, bytes_scanned, skipped_large_files, over OR full_list AS truncated,
        CASE WHEN over THEN 'byte-limit' WHEN full_list THEN 'file-limit' END AS truncation_reason FROM volume""",
    )
    add(
        "scanned_files",
        """SELECT b.scan_id, b.path, sha256(c.content) AS content_sha FROM budgeted b
        JOIN code_files c ON c.scan_id = b.scan_id AND c.path = b.path
        WHERE b.length <= 8000 AND running_bytes <= 20000""",
    )
    add(
        "line_explode",
        """SELECT scan_id, path AS file, unnest(ls) AS line, generate_subscripts(ls, 1)::INT AS line_no
        FROM (SELECT *, regexp_split_to_array(content, '\\r?\\n') AS ls FROM code_files) e""",
    )
    add(
        "line_windows",
        """SELECT scan_id, path AS file, (i + 1)::INT AS line_no, array_to_string(ls[i + 1 : i + 8], chr(10)) AS text
        FROM (SELECT *, unnest(range(0, len(ls), 4)) AS i FROM
          (SELECT *, regexp_split_to_array(content, '\\r?\\n') AS ls FROM code_files) e) w""",
    )
    add("line_findings", f"SELECT {FLAT} FROM rule_findings WHERE phase = 1")
    add("window_findings", f"SELECT {FLAT} FROM rule_findings WHERE phase = 2")
    add("html_findings", f"SELECT {FLAT} FROM rule_findings", {"eligible": "SELECT * FROM html_files"})
    add("secret_findings", f"SELECT {FLAT} FROM rule_findings WHERE starts_with(rule, 'SECRET-')")
    for rule in RULES:
        source = "src_windows" if rule.scope == "window" else "src_lines"
        add(
            "rule_" + rule.id.lower().replace("-", "_"),
            f"SELECT scan_id, path, line_no, text FROM {source} WHERE regexp_matches(text, {lit(rule.re2_pattern())})",
        )
    add("dependency_inventory", "SELECT scan_id, file, ecosystem, name, version, pos FROM inventory")
    add(
        "advisory_replies",
        "SELECT ecosystem, name, version, id, summary, word AS severity FROM adv WHERE word <> 'low'",
    )
    add("baseline_join", f"SELECT {FLAT} FROM baseline_findings")
    add("advisory_join", f"SELECT {FLAT} FROM advisory_findings")
    add("source_fallback", f"SELECT {FLAT} FROM fallback_findings")
    add("history_context", "SELECT scan_id, seq, line, commit, file FROM filled")
    add("history_findings", f"SELECT {FLAT}, commit FROM history_findings")
    add(
        "history_lines",
        """SELECT doc_id::VARCHAR AS scan_id, (i - 1)::BIGINT AS seq, line FROM (
          SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
            SELECT doc_id, ['commit:a', t[1]] ||
              flatten(list_transform(t[2:], lambda x: ['commit:x', '+' || x])) AS ls
            FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents) a) b) c""",
    )
    add("finding_union", f"SELECT {FLAT}, commit FROM own")
    add("finding_dedup", f"SELECT {FLAT}, commit, stage, n FROM deduped")
    add(
        "security_scores",
        f"""SELECT s.scan_id, greatest(0, 100 - coalesce(w, 0))::INT AS score FROM doc_scans s
        LEFT JOIN (SELECT scan_id, sum({WEIGHT}) AS w FROM deduped GROUP BY scan_id) d USING (scan_id)""",
    )
    add(
        "severity_counts",
        f"""SELECT scan_id, count(*) AS total_findings, count(*) FILTER (severity = 'critical') AS critical_total,
        count(*) FILTER (severity = 'high') AS high_total, sum({WEIGHT})::BIGINT AS weight
        FROM deduped GROUP BY scan_id""",
    )
    add(
        "top_findings",
        f"""SELECT scan_id, position::INT AS position, severity, rule, file, line
        FROM ({_rank_rows("deduped", _POS)}) r WHERE position <= {TOP_K}""",
    )
    add(
        "ranked_findings",
        f"""SELECT scan_id, position::INT AS position, severity, rule, file, line
        FROM ({_rank_rows("deduped", _POS)}) r""",
    )
    add(
        "report_rules",
        f"""SELECT scan_id, rule, min(position)::INT AS first_position, arg_max(title, position) AS title,
        arg_max(explanation, position) AS explanation, arg_max({LEVEL}, position) AS level
        FROM ({_rank_rows("deduped", _POS)}) r WHERE position <= 1000 GROUP BY scan_id, rule""",
    )
    add("severity_breakdown", "SELECT scan_id, severity, count(*) AS findings FROM stored GROUP BY ALL")
    add("scanner_breakdown", "SELECT scan_id, tool, count(*) AS findings FROM stored GROUP BY ALL")
    summary_files = """SELECT scan_id, count(*) AS files_scanned, sum(length)::BIGINT AS bytes_scanned FROM (
          SELECT scan_id, length FROM eligible UNION ALL SELECT scan_id, strlen(body) FROM lock_bodies) f GROUP BY scan_id"""
    lock_bodies = """SELECT scan_id, CASE WHEN o_orderkey % 10 = 9 AND kind <= 1 THEN left(full_body, 40) ELSE full_body END AS body
      FROM (SELECT o_orderkey, scan_id, kind, CASE kind
        WHEN 0 THEN '{"lockfileVersion": 3, "packages": {"": {"version": "9.9.9"}, ' ||
          string_agg('"node_modules/' || name || '": {"version": "' || version || '"}', ', ' ORDER BY pos) || '}}'
        WHEN 1 THEN '{"packages": [' || string_agg('{"name": "' || name || '", "version": "v' || version || '"}', ', ' ORDER BY pos) || ']}'
        WHEN 2 THEN '# pinned' || chr(10) || string_agg(name || '==' || version || ' ; marker', chr(10) ORDER BY pos) || chr(10) || 'other>=2' || chr(10)
        WHEN 3 THEN string_agg(name || ' v' || version || ' h1:aa=' || chr(10) || name || ' v' || version || '/go.mod h1:bb=', chr(10) ORDER BY pos)
        WHEN 4 THEN 'GEM' || chr(10) || '  specs:' || chr(10) || string_agg('    ' || name || ' (' || version || ')' || chr(10) || '      x (1)', chr(10) ORDER BY pos)
        ELSE 'version = 3' || chr(10) || string_agg('[[package]]' || chr(10) || 'name = "' || name || '"' || chr(10) || 'version = "' || version || '"' || chr(10), chr(10) ORDER BY pos)
        END AS full_body FROM all_deps GROUP BY o_orderkey, scan_id, kind) b"""
    all_deps = CTES["deps"].split("WHERE NOT")[0]
    add(
        "scan_summary",
        """SELECT s.scan_id, greatest(0, 100 - coalesce(weight, 0))::INT AS score, least(coalesce(total, 0), 1000)::INT AS open,
          0 AS resolved, least(coalesce(crit, 0), 1000)::INT AS critical,
          least(coalesce(t.high, 0), 1000 - least(coalesce(crit, 0), 1000))::INT AS high,
          coalesce(files_scanned, 0) AS files_scanned, coalesce(bytes_scanned, 0) AS bytes_scanned, 0::BIGINT AS skipped_large_files,
          coalesce(files_scanned, 0) >= 2500 AS truncated,
          CASE WHEN files_scanned >= 2500 THEN 'file-limit' END AS truncation_reason,
          'Source scan, Context scan, Secret scan' || CASE WHEN s.doc THEN ', Git history' ELSE '' END || ', OSV.dev' ||
            coalesce(x.names, '') AS scanners,
          coalesce(total, 0)::INT AS total_findings, least(coalesce(total, 0), 1000)::INT AS findings_returned,
          coalesce(total, 0) > 1000 AS findings_truncated
        FROM snapshot_list s LEFT JOIN totals t USING (scan_id) LEFT JOIN summary_files f USING (scan_id)
        LEFT JOIN ext_names x USING (scan_id)""",
        {
            "totals": _SUMMARY_TOTALS,
            "all_deps": all_deps,
            "lock_bodies": lock_bodies,
            "summary_files": summary_files,
            "ext_names": """SELECT scan_id, string_agg(', ' || tool, '' ORDER BY CASE tool WHEN 'Semgrep' THEN 1
                WHEN 'Gitleaks' THEN 2 ELSE 3 END) FILTER (available) AS names FROM tool_status
              GROUP BY scan_id HAVING sum(finding_count) > 0""",
        },
    )
    add(
        "full_scan_findings",
        f"""SELECT scan_id, position::INT AS position, severity, tool, rule, file, line, 'open' AS status
        FROM ({_rank_rows("final_findings", "o")}) r WHERE position <= 1000""",
    )
    for name, cte in (
        ("semgrep_findings", "semgrep"),
        ("gitleaks_findings", "gitleaks"),
        ("osv_report_findings", "osv_scanner"),
    ):
        add(name, f"SELECT {FLAT_EXT} FROM {cte}")
    add("external_tool_status", "SELECT scan_id, tool, available, finding_count FROM tool_status")
    add(
        "external_merge",
        f"""SELECT scan_id, count(*) AS total_findings, count(*) FILTER (severity = 'critical') AS critical_total,
        count(*) FILTER (severity = 'high') AS high_total, sum({WEIGHT})::BIGINT AS weight FROM (
          SELECT scan_id, severity FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, rule, file, line ORDER BY n DESC) AS no
            FROM fallback_findings) f WHERE no = 1
          UNION ALL SELECT scan_id, severity FROM external) u GROUP BY scan_id""",
    )
    add("rescan_pairs", "SELECT scan_id, previous_scan_id, score, previous_score FROM pairs")
    add(
        "compare_scans",
        """SELECT p.scan_id, p.previous_scan_id, p.score - p.previous_score AS score_change,
          coalesce(n.n, 0)::BIGINT AS new_findings, coalesce(x.n, 0)::BIGINT AS fixed_findings,
          coalesce(u.n, 0)::BIGINT AS unchanged_findings
        FROM pairs p LEFT JOIN (SELECT pair, count(*) AS n FROM side_new GROUP BY pair) n ON n.pair = p.scan_id
        LEFT JOIN (SELECT pair, count(*) AS n FROM side_fixed GROUP BY pair) x ON x.pair = p.scan_id
        LEFT JOIN (SELECT pair, count(*) AS n FROM side_same GROUP BY pair) u ON u.pair = p.scan_id""",
        {
            "side_new": _side("now", "before", "NOT"),
            "side_fixed": _side("before", "now", "NOT"),
            "side_same": _side("now", "before", ""),
        },
    )
    add("new_findings", _side("now", "before", "NOT"))
    add("unchanged_findings", _side("now", "before", ""))
    add("fixed_findings", _side("before", "now", "NOT"))
    add("compare_snapshots", *_compare_snapshots())
    add(
        "score_history",
        """SELECT url, scan_id, score, score - lag(score) OVER (PARTITION BY url ORDER BY created_at, scan_id) AS score_change
        FROM scans_v""",
    )
    add(
        "repository_urls",
        f"""SELECT c_custkey AS repo_id, CASE WHEN ok THEN owner END AS owner, CASE WHEN ok THEN name END AS repository,
          CASE WHEN ok THEN 'https://github.com/' || owner || '/' || name || CASE WHEN k = 2 THEN '.git' ELSE '' END || '.git' END AS clone_url,
          CASE WHEN ok THEN 'https://github.com/' || owner || '/' || name || CASE WHEN k = 2 THEN '.git' ELSE '' END END AS web_url,
          CASE WHEN k IN (3, 4) THEN {lit(repo.WRONG_HOST)} WHEN k = 5 THEN {lit(repo.WRONG_PATH)}
               WHEN k = 7 THEN {lit(repo.NOT_A_URL)} END AS reject_reason
        FROM (SELECT *, k IN (0, 1, 2, 6) AS ok FROM ({_URL}) u) v""".replace(
            "CASE WHEN ok THEN name END AS repository",
            "CASE WHEN ok THEN name || CASE WHEN k = 2 THEN '.git' ELSE '' END END AS repository",
        ),
    )
    kb = "trunc(abs(c_acctbal) * 50)::BIGINT"
    add(
        "repository_admission",
        f"""SELECT c_custkey AS repo_id, CASE WHEN {kb} > 250000 THEN 'Repository size ' || {kb} || ' KB exceeds the configured 250000 KB limit.'
          WHEN c_custkey % 11 = 0 THEN {lit(repo.ARCHIVED)} END AS reject_reason FROM customer""",
    )
    add(
        "admitted_repositories",
        f"SELECT c_custkey AS repo_id, {kb} AS size_kb FROM customer WHERE {kb} <= 250000 AND c_custkey % 11 <> 0",
    )
    entries = """SELECT l_suppkey::VARCHAR AS scan_id, l_orderkey, l_linenumber, l_partkey,
        ['File','SymbolicLink','Directory','FIFO','File','File','Link'][l_linenumber % 7 + 1] AS entry_type,
        trunc(l_extendedprice)::BIGINT AS size FROM lineitem"""
    add(
        "archive_guard",
        f"""SELECT scan_id, l_orderkey, l_linenumber, l_partkey, entry_type, size FROM (
          SELECT *, count(*) OVER (PARTITION BY scan_id) AS c, sum(size) OVER (PARTITION BY scan_id) AS b FROM entries) e
        WHERE c <= {ARCHIVE_ENTRIES} AND b <= {ARCHIVE_BYTES}
          AND entry_type NOT IN ('SymbolicLink','Link','CharacterDevice','BlockDevice','FIFO')""",
        {"entries": entries},
    )
    add(
        "archive_verdicts",
        f"""SELECT scan_id, count(*) AS entries, sum(size)::BIGINT AS declared_bytes,
          count(*) > {ARCHIVE_ENTRIES} OR sum(size) > {ARCHIVE_BYTES} AS rejected FROM listed GROUP BY scan_id""",
        {"listed": entries},
    )
    add(
        "snapshot_sizes",
        """SELECT scan_id, coalesce(sum(length) FILTER (entry_type = 'file'), 0)::BIGINT AS clone_bytes,
          coalesce(sum(length) FILTER (entry_type = 'file'), 0) > 30000 AS rejected FROM code_files GROUP BY scan_id""",
    )
    for name in ("scan_upsert", "stored_upsert"):
        add(
            name,
            """SELECT scan_id, url, score FROM scans_v WHERE NOT (score > 50 AND score <= 75)
            UNION ALL SELECT CASE WHEN score > 75 THEN 'n' || scan_id ELSE scan_id END, url, score + 1 FROM scans_v WHERE score > 50""",
        )
    add(
        "scan_retention",
        """SELECT scan_id, url, score FROM scans_v WHERE created_at >= TIMESTAMP '2002-01-01' - INTERVAL 400 DAY
        ORDER BY created_at DESC, scan_id DESC LIMIT 50""",
    )
    add("recent_scans", "SELECT scan_id, url, score FROM scans_v ORDER BY created_at DESC, scan_id DESC LIMIT 50")
    for name in ("scan_lookup", "stored_lookup"):
        add(name, "SELECT scan_id, url, score FROM scans_v WHERE scan_id = '117'")
    add(
        "scan_list",
        """SELECT s.scan_id, s.url, s.score, coalesce(n, 0)::BIGINT AS finding_count FROM scans_v s
        LEFT JOIN (SELECT scan_id, count(*) AS n FROM stored GROUP BY scan_id) f ON f.scan_id = s.scan_id""",
    )
    add(
        "store_metrics",
        """SELECT (SELECT count(*) FROM scans_v) AS scans_stored,
          (SELECT count(*) FROM stored WHERE scan_id IN (SELECT scan_id FROM scans_v)) AS findings_stored""",
    )
    add(
        "valid_decisions",
        "SELECT event_id, scan_id, finding_id, action FROM reviewed WHERE action IN ('approve', 'reject')",
    )
    add(
        "review_log",
        """SELECT event_id, scan_id, finding_id, 'finding_decision' AS type, action, NULL::VARCHAR AS pull_request
        FROM reviewed WHERE action IN ('approve', 'reject')
        UNION ALL SELECT -1, scan_id, id, 'remediation_pull_request', NULL, 'pr' FROM under_review WHERE user_id % 5 = 0 AND n = 0""",
    )
    add(
        "apply_decisions",
        "SELECT scan_id, finding_key, status, decision, epoch_us(decided_at) AS decided_us FROM after_review",
    )
    add(
        "pull_request_findings",
        """SELECT u.scan_id, u.finding_key,
          coalesce(p.pr, CASE WHEN u.user_id % 5 = 0 THEN 'pr' END) AS remediation_pull_request
        FROM under_review u LEFT JOIN (
          SELECT user_id, 'pr-' || arg_max(event_id, {'t': ts, 'e': event_id}) AS pr
          FROM events WHERE event_type = 'purchase' GROUP BY user_id) p
        ON p.user_id = u.user_id AND u.n = 0""",
    )
    add("open_recount", "SELECT scan_id, count(*) FILTER (status = 'open')::INT AS open FROM after_review GROUP BY scan_id")
    add(
        "remediation_targets",
        f"""SELECT scan_id, id, finding_key,
          regexp_replace({lit(BRANCH_PREFIX)}, '[^A-Za-z0-9/_-]', '-', 'g') || '-' ||
            substr(regexp_replace(lower(id), '[^a-z0-9-]', '-', 'g'), 1, 48) || '-' || lower(to_base(epoch_us(decided_at) // 1000, 36)) AS branch,
          '.audit/remediation-' || regexp_replace(id, '[^A-Za-z0-9_.-]', '-', 'g') || '.md' AS plan_path
        FROM after_review WHERE decision = 'approve' AND user_id % 5 <> 0""",
    )
    cleaned = f"regexp_replace(regexp_replace({trim('reply')}, '<[^>]+>', '', 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')"
    add(
        "attach_explanations",
        f"""SELECT scan_id, finding_key, CASE WHEN n = 0 THEN nullif(substr({cleaned}, 1, 2000), '') END AS ai_explanation
        FROM (SELECT *, CASE user_id % 3 WHEN 0 THEN '  <b>Fix</b> it' || chr(9) || 'now ' || user_id || chr(1) || ' '
                                         WHEN 1 THEN '<p></p>' END AS reply FROM under_review) u""",
    )
    head = "\n".join(INSTRUCTIONS)
    add(
        "explanation_prompts",
        f"""SELECT scan_id, finding_key, {lit(head)} || chr(10) || '{{"title":"Title <' || user_id || '>","severity":"' || severity ||
          '","rule":"R","file":"src/f' || user_id || '.js","line":' || (n + 1) ||
          ',"evidence":"<EVIDENCE>password = ''[REDACTED]''\\n\\tcall(' || user_id || ')</EVIDENCE>"}}' AS prompt FROM under_review""",
    )
    add(
        "sarif_reports",
        f"""SELECT s.scan_id, '{{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{{"tool":{{"driver":{{"name":"{TOOL_NAME}","version":"1.0.0","rules":['
          || coalesce(rules, '') || ']}}}},"results":[' || coalesce(results, '') || ']}}]}}' AS sarif
        FROM doc_scans s LEFT JOIN sarif_rules r USING (scan_id) LEFT JOIN sarif_results x USING (scan_id)""",
        {
            "stored_findings": _STORED,
            "sarif_rule_rows": f"""SELECT scan_id, rule, min(position) AS p, arg_max(title, position) AS title,
                arg_max(explanation, position) AS explanation, arg_max({LEVEL}, position) AS level
              FROM stored_findings GROUP BY scan_id, rule""",
            "sarif_rules": """SELECT scan_id, string_agg('{"id":' || to_json(rule) || ',"name":' || to_json(title) ||
                ',"shortDescription":{"text":' || to_json(title) || '},"fullDescription":{"text":' || to_json(explanation) ||
                '},"defaultConfiguration":{"level":' || to_json(level) || '}}', ',' ORDER BY p) AS rules
              FROM sarif_rule_rows GROUP BY scan_id""",
            "sarif_results": f"""SELECT scan_id, string_agg('{{"ruleId":' || to_json(rule) || ',"level":' || to_json({LEVEL}) ||
                ',"message":{{"text":' || to_json(title) || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' ||
                to_json(file) || '}},"region":{{"startLine":' || line || '}}}}}}]}}', ',' ORDER BY position) AS results
              FROM stored_findings GROUP BY scan_id""",
        },
    )
    add(
        "json_reports",
        """SELECT s.scan_id, coalesce(n, 0)::INT AS n, coalesce(ids, '') AS ids FROM doc_scans s LEFT JOIN (
          SELECT scan_id, count(*) AS n, string_agg(id || '|' || file || '|' || line, ';' ORDER BY position) AS ids
          FROM stored_findings GROUP BY scan_id) d USING (scan_id)""",
        {"stored_findings": _STORED},
    )
    add(
        "sarif_report_parts",
        f"""SELECT scan_id, 0 AS section, 0 AS position, '{{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{{"tool":{{"driver":{{"name":"{TOOL_NAME}","version":"1.0.0","rules":[' AS text FROM doc_scans
        UNION ALL SELECT scan_id, 1, p::INT, CASE WHEN p > 1 THEN ',' ELSE '' END || to_json({{'id': rule, 'name': title,
          'shortDescription': {{'text': title}}, 'fullDescription': {{'text': explanation}}, 'defaultConfiguration': {{'level': level}}}})
          FROM (SELECT scan_id, rule, min(position) AS p, arg_max(title, position) AS title,
            arg_max(explanation, position) AS explanation, arg_max({LEVEL}, position) AS level
            FROM stored_findings GROUP BY scan_id, rule) r
        UNION ALL SELECT scan_id, 2, 0, ']}}}},"results":[' FROM doc_scans
        UNION ALL SELECT scan_id, 3, position::INT, CASE WHEN position > 1 THEN ',' ELSE '' END || to_json({{'ruleId': rule,
          'level': {LEVEL}, 'message': {{'text': title}},
          'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': file}}, 'region': {{'startLine': line}}}}}}]}})
          FROM stored_findings
        UNION ALL SELECT scan_id, 4, 0, ']}}]}}' FROM doc_scans""",
        {"stored_findings": _STORED},
    )
    add(
        "scan_report_parts",
        """SELECT scan_id, 0 AS section, 0 AS position, '{"id":' || to_json(scan_id) || ',"createdAt":"' ||
          strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') || '","previousScanId":' || to_json(previous_scan_id) ||
          ',"repository":{"url":' || to_json('c/' || url) || '},"findings":[' AS text FROM scans_v
        UNION ALL SELECT scan_id, 1, place::INT, CASE WHEN place > 1 THEN ',' ELSE '' END || to_json({'severity': severity,
          'tool': tool, 'rule': rule, 'file': file, 'line': line, 'fingerprint': fingerprint})
          FROM placed WHERE scan_id IN (SELECT scan_id FROM scans_v)
        UNION ALL SELECT s.scan_id, 4, 0, '],"summary":' || to_json({'score': s.score, 'totalFindings': coalesce(t.n, 0),
            'critical': coalesce(t.c, 0), 'high': coalesce(t.h, 0)}) || ',"comparison":' ||
            CASE WHEN p.scan_id IS NULL THEN 'null' ELSE to_json({'scoreChange': p.score - p.previous_score,
              'newFindings': coalesce(k.a, 0), 'fixedFindings': coalesce(k.b, 0), 'unchangedFindings': coalesce(k.c, 0)})::VARCHAR END || '}'
          FROM scans_v s LEFT JOIN (SELECT scan_id, count(*) AS n, count(*) FILTER (severity = 'critical') AS c,
            count(*) FILTER (severity = 'high') AS h FROM stored GROUP BY scan_id) t USING (scan_id)
          LEFT JOIN pairs p ON p.scan_id = s.scan_id LEFT JOIN (SELECT pair, count(*) FILTER (kind = 'n') AS a,
            count(*) FILTER (kind = 'f') AS b, count(*) FILTER (kind = 's') AS c FROM kinds GROUP BY pair) k ON k.pair = s.scan_id""",
        {
            "stored": CTES["stored"].replace("SELECT", "SELECT DISTINCT", 1),
            "placed": f"SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {RANK}, line, rule, file, tool) AS place FROM stored",
            "kinds": "SELECT pair, 'n' AS kind FROM (" + _side("now", "before", "NOT") + ") a UNION ALL SELECT pair, 'f' FROM ("
            + _side("before", "now", "NOT") + ") b UNION ALL SELECT pair, 's' FROM (" + _side("now", "before", "") + ") c",
        },
    )
    iso = "'%Y-%m-%dT%H:%M:%S.%gZ'"
    add(
        "review_report_parts",
        f"""SELECT scan_id, 0 AS section, 0 AS position, '{{"id":' || to_json(scan_id) || ',"status":"complete","findings":[' AS text FROM held
        UNION ALL SELECT scan_id, 1, place::INT, CASE WHEN place > 1 THEN ',' ELSE '' END || to_json({{'id': id, 'severity': severity,
          'title': 'Title <' || user_id || '>', 'rule': 'R', 'file': 'src/f' || user_id || '.js', 'line': n + 1,
          'explanation': 'Why & how', 'evidence': 'password = ' || chr(39) || 'abc' || user_id || chr(39) || chr(10) || chr(9) || 'call(' || user_id || ')',
          'patch': ['- old', '+ new ' || user_id], 'status': status, 'decision': decision,
          'decidedAt': strftime(decided_at, {iso}), 'aiExplanation': NULL::VARCHAR,
          'remediationPullRequest': CASE WHEN user_id % 5 = 0 THEN 'pr' END}})
          FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {RANK}, user_id, n) AS place FROM after_review) f
        UNION ALL SELECT scan_id, 2, 0, '],"events":[' FROM held
        UNION ALL SELECT scan_id, 3, place::INT, CASE WHEN place > 1 THEN ',' ELSE '' END || to_json({{'type': type,
          'findingId': finding_id, 'action': action, 'pullRequest': pr, 'createdAt': strftime(ts, {iso})}})
          FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ts, event_id, type, finding_id) AS place FROM logged) e
        UNION ALL SELECT scan_id, 4, 0, '],"summary":{{"open":' || open || '}}}}' FROM held""",
        {
            "held": "SELECT scan_id, count(*) FILTER (status = 'open') AS open FROM after_review GROUP BY scan_id",
            "logged": """SELECT scan_id, event_id, 'finding_decision' AS type, finding_id, action, NULL::VARCHAR AS pr, ts::TIMESTAMP AS ts
                FROM reviewed WHERE action IN ('approve', 'reject')
              UNION ALL SELECT scan_id, -1, 'remediation_pull_request', id, NULL, 'pr', TIMESTAMP '2002-01-01'
                FROM under_review WHERE user_id % 5 = 0 AND n = 0""",
        },
    )
    add(
        "remediation_plans",
        f"""SELECT scan_id, id, n::BIGINT AS n, '# {TOOL_NAME} remediation plan' || chr(10) || chr(10) || '- Scan: ' || scan_id || chr(10) ||
          '- Repository commit: ' || sha256(scan_id) || chr(10) || '- Finding: ' || id || chr(10) || '- Severity: ' || severity || chr(10) ||
          '- Location: src/f' || user_id || '.js:' || (n + 1) || chr(10) || chr(10) || '## Finding' || chr(10) || chr(10) ||
          'Title &lt;' || user_id || '&gt;' || chr(10) || chr(10) || 'Why & how' || chr(10) || chr(10) || '## Evidence' || chr(10) || chr(10) ||
          '    password = ''abc' || user_id || '''' || chr(10) || '    ' || chr(9) || 'call(' || user_id || ')' || chr(10) || chr(10) ||
          '## Recommended change' || chr(10) || chr(10) || '    - old' || chr(10) || '    + new ' || user_id || chr(10) || chr(10) ||
          '> Review and implement this recommendation before merging. {TOOL_NAME} intentionally does not execute repository code.' || chr(10) AS document
        FROM under_review""",
    )
    add("job_table", "SELECT job_id, status, progress, phase FROM job_now")
    add(
        "job_stats",
        """SELECT count(*) FILTER (status = 'running') AS active, count(*) FILTER (status = 'queued') AS queued,
          count(*) FILTER (status = 'complete') AS completed, count(*) FILTER (status = 'failed') AS failed FROM job_now""",
    )
    add(
        "live_jobs",
        """SELECT job_id, status FROM job_now WHERE NOT (status IN ('complete', 'failed')
          AND updated_at < TIMESTAMP '2024-01-31' - INTERVAL 6 HOUR)""",
    )
    add(
        "failed_jobs",
        """SELECT job_id, CASE WHEN e % 3 = 1 THEN substr('phase error ' || repeat('x', (e % 1000)::INT), 1, 500)
          ELSE 'Scan failed' END AS error
        FROM (SELECT job_id, arg_max(status, {'t': ts, 'e': event_id}) AS status, arg_max(phase, {'t': ts, 'e': event_id}) AS phase,
          arg_max(event_id, {'t': ts, 'e': event_id}) AS e FROM jobs GROUP BY job_id) j WHERE status = 'failed'""",
    )
    add(
        "live_job_stream",
        """SELECT job_id, status, progress, phase FROM job_now WHERE NOT (status IN ('complete', 'failed')
          AND updated_at < (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 6 HOUR)""",
    )
    rates = f"""SELECT event_id, client, category, ts_ms, start AS window_start, c AS position,
          c <= CASE category WHEN 'scan' THEN {RATE_LIMITS["scan"]} ELSE {RATE_LIMITS["api"]} END AS allowed FROM walk"""
    rate_tables = {
        "req": """SELECT event_id, user_id::VARCHAR AS client, CASE WHEN event_type = 'signup' THEN 'scan' ELSE 'api' END AS category,
            epoch_us(ts) // 1000 AS ts_ms FROM events""",
        "req_no": "SELECT *, row_number() OVER (PARTITION BY client, category ORDER BY ts_ms, event_id) AS no FROM req",
        "walk": f"""SELECT event_id, client, category, ts_ms, no, ts_ms AS start, 1::BIGINT AS c FROM req_no WHERE no = 1
          UNION ALL SELECT r.event_id, r.client, r.category, r.ts_ms, r.no,
            CASE WHEN r.ts_ms - w.start > {RATE_WINDOW_MS} THEN r.ts_ms ELSE w.start END,
            CASE WHEN r.ts_ms - w.start > {RATE_WINDOW_MS} THEN 1 ELSE w.c + 1 END
          FROM walk w JOIN req_no r ON r.client = w.client AND r.category = w.category AND r.no = w.no + 1""",
    }
    add("rate_verdicts", rates, rate_tables)
    add("rate_stream", rates, rate_tables)
    for stream, batch in (("job_stream", "job_table"), ("decision_stream", "apply_decisions"),
                          ("scan_stream_all", "scan_summary"), ("rescan_stream", "compare_snapshots")):
        q[stream] = q[batch]
    add(
        "scan_stream",
        f"""SELECT s.scan_id, greatest(0, 100 - coalesce(weight, 0))::INT AS score, coalesce(total, 0)::INT AS open,
          coalesce(crit, 0)::INT AS critical, coalesce(t.high, 0)::INT AS high, coalesce(f.n, 0)::BIGINT AS files_scanned,
          coalesce(total, 0)::INT AS total_findings
        FROM doc_scans s LEFT JOIN totals t USING (scan_id)
        LEFT JOIN (SELECT scan_id, count(*) AS n FROM eligible GROUP BY scan_id) f USING (scan_id)""",
        {"totals": _SUMMARY_TOTALS.replace("final_findings", "deduped")},
    )
    return {name: with_ctes(final, extra) for name, (final, extra) in q.items()}


def _compare_snapshots() -> tuple[str, dict[str, str]]:
    """Both states through the same rule tables, compared by fingerprint."""
    both = """SELECT * FROM code_files UNION ALL SELECT * FROM code_files_prev"""
    return (
        """SELECT s.scan_id, 'prev-' || s.scan_id AS previous_scan_id,
            (greatest(0, 100 - coalesce(a.w, 0)) - greatest(0, 100 - coalesce(b.w, 0)))::INT AS score_change,
            coalesce(x.new, 0)::BIGINT AS new_findings, coalesce(y.fixed, 0)::BIGINT AS fixed_findings,
            coalesce(x.same, 0)::BIGINT AS unchanged_findings
          FROM doc_scans s LEFT JOIN lost a ON a.scan_id = s.scan_id
          LEFT JOIN lost b ON b.scan_id = 'prev-' || s.scan_id
          LEFT JOIN (SELECT u.scan_id, count(*) FILTER (NOT hit) AS new, count(*) FILTER (hit) AS same FROM (
              SELECT scan_id, EXISTS (SELECT 1 FROM uniq p WHERE p.scan_id = 'prev-' || c.scan_id AND p.fingerprint = c.fingerprint) AS hit
              FROM uniq c) u GROUP BY u.scan_id) x ON x.scan_id = s.scan_id
          LEFT JOIN (SELECT u.scan_id, count(*) FILTER (NOT hit) AS fixed FROM (
              SELECT substr(scan_id, 6) AS scan_id, EXISTS (SELECT 1 FROM uniq p WHERE p.scan_id = substr(c.scan_id, 6) AND p.fingerprint = c.fingerprint) AS hit
              FROM uniq c WHERE starts_with(scan_id, 'prev-')) u GROUP BY u.scan_id) y ON y.scan_id = s.scan_id""",
        {
            "both_states": both,
            "eligible": _eligible_from("both_states"),
            "uniq": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, rule, file, line
                ORDER BY {_POS}) AS no FROM rule_findings) r WHERE no = 1""",
            "lost": f"SELECT scan_id, sum({WEIGHT}) AS w FROM uniq GROUP BY scan_id",
        },
    )


def _eligible_from(table: str) -> str:
    return CTES["eligible"].replace("code_files", table)

