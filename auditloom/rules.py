"""Rule catalogue.

Patterns are templates: ``{ws}`` is the whitespace set, ``{wb}`` an ASCII word
boundary before a word character and ``{dot}`` any character that does not end
a line. ``needs`` names literals of which at least one occurs in every match
(lower case where the rule ignores case); they only spare regex work.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.text import WORD_START, WS

LINE, WINDOW = "line", "window"
SOURCE_TOOL, SECRET_TOOL, CONTEXT_TOOL = "Source scan", "Secret scan", "Context scan"
HISTORY_TOOL, BASELINE_TOOL, ADVISORY_TOOL = "Git history", "Dependency audit", "OSV.dev"

# Texts used by rules that carry none of their own.
SECRET_EXPLANATION = (
    "A likely secret is present in tracked source. Rotate it and load the replacement "
    "from a protected runtime variable."
)
SECRET_PATCH = ("- hard-coded credential", "+ process.env.SECRET_NAME")


@dataclass(frozen=True)
class Rule:
    ord: int
    id: str
    tool: str
    severity: str
    title: str
    pattern: str
    needs: tuple[str, ...]
    ignore_case: bool = False
    explanation: str = SECRET_EXPLANATION
    patch: tuple[str, ...] = SECRET_PATCH

    @property
    def scope(self) -> str:
        return WINDOW if self.tool == CONTEXT_TOOL else LINE

    def java_pattern(self) -> str:
        return self._render(WORD_START)

    def re2_pattern(self) -> str:
        return self._render(r"\b")

    def _render(self, boundary: str) -> str:
        text = (
            self.pattern.replace("{ws}", f"[{WS}]")
            .replace("{wb}", boundary)
            .replace("{dot}", r"[^\n\r\x{2028}\x{2029}]")
        )
        return ("(?i)" if self.ignore_case else "") + text

    def matches(self, text: Column, folded: Column) -> Column:
        """Literal test first, then the pattern. ``folded`` is the lower-cased text."""
        hay = folded if self.ignore_case else text
        literal = None
        for word in self.needs:
            found = hay.contains(word)
            literal = found if literal is None else literal | found
        return literal & text.rlike(self.java_pattern())


# The rules, in the order in which they are applied.
RULES: tuple[Rule, ...] = (
    Rule(
        0, "SEC-EVAL", SOURCE_TOOL, "high", "Dynamic code execution",
        r"{wb}eval{ws}*\({dot}+",
        ("eval",),
        explanation="eval executes text as code. If any portion is user controlled, this can "
        "become remote code execution.",
        patch=(
            "- eval(value)",
            "+ Replace dynamic evaluation with an explicit parser or allow-listed command map.",
        ),
    ),
    Rule(
        1, "SEC-EXEC", SOURCE_TOOL, "critical", "Shell command built from request data",
        r"(?:exec|execSync){ws}*\([^\n]*(?:req\.|request\.|params|query|body)",
        ("exec",),
        explanation="Request data appears to reach a shell command. An attacker may be able to "
        "inject additional commands.",
        patch=(
            "- exec(commandFromRequest)",
            "+ Use spawn/execFile with a fixed executable and validated argument allow-list.",
        ),
    ),
    Rule(
        2, "SEC-NOSQL", SOURCE_TOOL, "critical", "Request object passed to a database query",
        r"(?:findOne|find|updateOne|deleteOne){ws}*\([^\n]*(?:req\.(?:body|query|params)|request\.)",
        ("req.", "request."),
        explanation="An untrusted request value appears inside a database query. Convert it to "
        "the expected primitive type and validate it first.",
        patch=(
            "- collection.findOne({ field: req.body.field })",
            "+ const field = validateField(String(req.body.field ?? ''));",
            "+ collection.findOne({ field })",
        ),
    ),
    Rule(
        3, "SEC-XSS", SOURCE_TOOL, "high", "Untrusted HTML assignment",
        r"(?:innerHTML{ws}*=|document\.write{ws}*\()[^\n]*(?:req\.|location\.|searchParams|user)",
        ("innerhtml", "document.write"),
        ignore_case=True,
        explanation="User-controlled content is written into an HTML sink. Render it as text or "
        "use context-aware escaping.",
        patch=("- element.innerHTML = value", "+ element.textContent = value"),
    ),
    Rule(
        4, "SEC-TLS", SOURCE_TOOL, "medium", "TLS certificate verification disabled",
        r"""rejectUnauthorized{ws}*:{ws}*false|NODE_TLS_REJECT_UNAUTHORIZED{ws}*={ws}*["']?0""",
        ("rejectunauthorized", "node_tls_reject_unauthorized"),
        ignore_case=True,
        explanation="Disabling certificate validation makes HTTPS connections vulnerable to "
        "interception.",
        patch=(
            "- rejectUnauthorized: false",
            "+ Use the default certificate verification and configure a trusted CA if required.",
        ),
    ),
    Rule(
        5, "SECRET-AWS", SECRET_TOOL, "critical", "AWS access key committed to source",
        r"AKIA[0-9A-Z]{16}",
        ("AKIA",),
    ),
    Rule(
        6, "SECRET-PRIVATE-KEY", SECRET_TOOL, "critical", "Private key committed to source",
        r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
        ("PRIVATE KEY-----",),
    ),
    Rule(
        7, "SECRET-GENERIC", SECRET_TOOL, "high", "Hard-coded credential",
        r"""(?:api[_-]?key|secret|password|token){ws}*[=:]{ws}*["'][A-Za-z0-9_\-/.+=]{12,}["']""",
        ("key", "secret", "password", "token"),
        ignore_case=True,
    ),
    Rule(
        8, "SEC-EXEC-FLOW", CONTEXT_TOOL, "critical", "Request data may reach a shell command",
        r"(?:req\.(?:body|query|params)|request\.(?:args|form|json))[\s\S]{0,500}"
        r"(?:exec|execSync|spawn|subprocess\.(?:run|Popen)|Runtime\.getRuntime\(\)\.exec){ws}*\(",
        ("req.", "request."),
        ignore_case=True,
        explanation="Request-controlled data and a process-execution sink occur in the same local "
        "code window. Confirm the data flow and replace shell construction with a fixed "
        "executable and validated arguments.",
        patch=(
            "- shell command assembled from request data",
            "+ fixed executable with an allow-listed argument array",
        ),
    ),
    Rule(
        9, "SEC-QUERY-FLOW", CONTEXT_TOOL, "high", "Request data may reach a database query",
        r"(?:req\.(?:body|query|params)|request\.(?:args|form|json))[\s\S]{0,500}"
        r"(?:findOne|updateOne|deleteOne|execute|query){ws}*\(",
        ("req.", "request."),
        ignore_case=True,
        explanation="Request-controlled data and a database query occur in the same local code "
        "window. Use typed validation and parameterized queries.",
        patch=(
            "- query built from request data",
            "+ validated primitives and a parameterized query",
        ),
    ),
    Rule(
        10, "SEC-PY-SHELL", CONTEXT_TOOL, "critical", "Python subprocess enables a shell",
        r"subprocess\.(?:run|Popen|call){ws}*\([\s\S]{0,400}shell{ws}*={ws}*True",
        ("subprocess.",),
        ignore_case=True,
        explanation="A Python subprocess enables shell parsing. Use an argument list with "
        "shell=False and validate every untrusted argument.",
        patch=(
            "- subprocess.run(command, shell=True)",
            "+ subprocess.run([executable, validated_argument], shell=False, check=True)",
        ),
    ),
    Rule(
        11, "SEC-REACT-HTML", CONTEXT_TOOL, "high", "Potential untrusted React HTML injection",
        r"dangerouslySetInnerHTML{ws}*={ws}*\{[\s\S]{0,350}(?:user|message|content|query|param)",
        ("dangerouslysetinnerhtml",),
        ignore_case=True,
        explanation="Content is supplied to React's raw HTML escape hatch. Sanitize with a "
        "maintained allow-list sanitizer or render it as text.",
        patch=(
            "- dangerouslySetInnerHTML={{ __html: content }}",
            "+ render trusted structured elements or sanitized content",
        ),
    ),
)

LINE_RULES = tuple(r for r in RULES if r.scope == LINE)
WINDOW_RULES = tuple(r for r in RULES if r.scope == WINDOW)
SECRET_RULES = tuple(r for r in RULES if r.tool == SECRET_TOOL)


TEXTS = (
    "rule:string,tool:string,severity:string,title:string,explanation:string,patch:array<string>"
)


def rule_texts(ord_col: Column) -> Column:
    """Struct of the catalogue texts of a rule, looked up in a constant array.

    The array is one JSON literal, which the optimizer folds into a constant.
    """
    texts = [
        {
            "rule": r.id, "tool": r.tool, "severity": r.severity, "title": r.title,
            "explanation": r.explanation, "patch": r.patch,
        }
        for r in RULES
    ]
    table = F.from_json(F.lit(json.dumps(texts)), f"array<struct<{TEXTS}>>")
    return F.get(table, ord_col)


def rules_table(spark: SparkSession) -> DataFrame:
    """The catalogue as rows."""
    rows = [
        (r.ord, r.id, r.scope, r.severity, r.title, r.java_pattern(), r.explanation, list(r.patch))
        for r in RULES
    ]
    return spark.createDataFrame(
        rows,
        "rule_ord int, rule string, scope string, severity string, title string, "
        "pattern string, explanation string, patch array<string>",
    )
