"""String columns: evidence, fingerprints, ids, clean-up and escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of the ECMAScript \s class, written so that
# Java regular expressions and RE2 both accept it inside [...].
WS = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)

# The same set as characters.
WS_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# ASCII word boundaries; Java's own \b is Unicode-aware.
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"

EVIDENCE_CHARS = 500
SECRET_EVIDENCE_CHARS = 260
STABLE_CHARS = 300
FINGERPRINT_HEX = 24
ERROR_CHARS = 500


def trim_space(col: Column) -> Column:
    return F.btrim(col, F.lit(WS_CHARS))


def norm_path(col: Column) -> Column:
    return F.translate(col, "\\", "/")


# A free-standing number. The look-behind follows the first digit, so that it is
# tried at digits only.
NUMBER = rf"[0-9](?<![A-Za-z0-9_][0-9])[0-9]*{WORD_END}"


def stable_evidence(col: Column) -> Column:
    """Evidence with whitespace runs collapsed and free-standing numbers masked.

    The large whitespace class is slow; text of printable ASCII does without it.
    """
    collapsed = F.when(
        col.rlike("[^ -~]"), F.regexp_replace(col, rf"[{WS}]+", " ")
    ).otherwise(F.regexp_replace(col, "  +", " "))
    masked = F.regexp_replace(collapsed, NUMBER, "#")
    return F.substring(F.trim(masked), 1, STABLE_CHARS)


def fingerprint(rule: Column, file: Column, evidence: Column) -> Column:
    """Line-number independent identity of a finding, over unredacted evidence."""
    text = F.concat(rule, F.lit(":"), norm_path(file), F.lit(":"), stable_evidence(evidence))
    return F.substring(F.sha2(text, 256), 1, FINGERPRINT_HEX)


def _hex_tail(col: Column, digits: int) -> Column:
    return F.lower(F.right(F.hex(F.encode(col, "UTF-8")), F.lit(digits)))


def finding_id(rule: Column, file: Column, line: Column) -> Column:
    tail = _hex_tail(F.concat(file, F.lit(":"), line.cast("string")), 8)
    return F.concat(rule, F.lit("-"), tail)


def history_finding_id(rule: Column, commit: Column, file: Column) -> Column:
    tail = _hex_tail(F.concat(commit, F.lit(":"), file), 10)
    return F.concat(rule, F.lit("-HISTORY-"), tail)


def finding_key(rule: Column, file: Column, line: Column) -> Column:
    return F.concat(rule, F.lit(":"), file, F.lit(":"), line.cast("string"))


def redact(col: Column) -> Column:
    """Hide the tail of each quoted value of seven or more characters."""
    hidden = F.regexp_replace(col, r"""(["'])([^"']{6})[^"']+(["'])""", "$1$2…redacted…$3")
    return F.substring(hidden, 1, SECRET_EVIDENCE_CHARS)


def evidence(is_secret: Column, text: Column) -> Column:
    plain = F.substring(trim_space(text), 1, EVIDENCE_CHARS)
    return F.when(is_secret, redact(trim_space(text))).otherwise(plain)


def clean_error(col: Column) -> Column:
    return F.substring(F.regexp_replace(col, r"[\r\n]+", " "), 1, ERROR_CHARS)


def escape_angle(col: Column) -> Column:
    escaped = F.replace(F.coalesce(col, F.lit("")), F.lit("<"), F.lit("&lt;"))
    return F.replace(escaped, F.lit(">"), F.lit("&gt;"))


def indent_block(col: Column) -> Column:
    """Each line of the text behind four spaces, joined by plain newlines."""
    lines = F.split(F.coalesce(col, F.lit("")), r"\r?\n", -1)
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("    "), x)), "\n")


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def whole_json(col: Column, closing: str) -> Column:
    """The text if it ends like a whole document, else NULL.

    The JSON parser stops behind the first value and would take a text with
    anything after it.
    """
    return F.when(F.rtrim(col, F.lit(" \t\r\n")).endswith(closing), col)
