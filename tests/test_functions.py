"""Column functions at their edges."""

import hashlib

import pytest
from pyspark.sql import functions as F

from auditloom.functions import prompts, severity, slugs, text, versions


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize(
    ("version", "bound", "below"),
    [
        ("4.17.15", "4.17.21", True), ("4.17.21", "4.17.21", False), ("v4.17.20", "4.17.21", True),
        ("4.17.21-rc1", "4.17.21", True), ("4.18", "4.17.21", False), ("4", "4.0.1", True),
        ("4.0.0", "4", False), ("^1.2.5", "1.2.6", True), ("10.0", "9.9", False),
        ("", "0.1", True), ("latest", "1.0", True), ("1.2.6.0", "1.2.6", False),
    ],
)
def test_version_below(spark, version, bound, below):
    assert value(spark, versions.version_below(F.lit(version), F.lit(bound))) is below


def test_severity_maps_differ_by_source(spark):
    words = ["CRITICAL", "High", "moderate", "medium", "low", "error", "WARNING", "info", "", None]
    tools = ["critical", "high", "low", "medium", "low", "high", "medium", "low", "medium", "medium"]
    advisories = ["critical", "high", "medium", "medium"] + ["high"] * 6
    for word, tool, advisory in zip(words, tools, advisories):
        assert value(spark, severity.norm_severity(F.lit(word).cast("string"))) == tool
        assert value(spark, severity.norm_advisory_severity(F.lit(word).cast("string"))) == advisory
    assert value(spark, severity.severity_rank(F.lit("odd"))) == 4


def test_stable_evidence_masks_numbers_and_collapses_space(spark):
    raw = "  a \t12 b3 é4 5_6 7é\n"
    # Letters outside ASCII are no word characters here.
    assert value(spark, text.stable_evidence(F.lit(raw))) == "a # b3 é# 5_6 #é"
    assert len(value(spark, text.stable_evidence(F.lit("x" * 400)))) == 300


def test_fingerprint_ignores_line_numbers_and_slashes(spark):
    args = (F.lit("R"), F.lit("a\\b.js"), F.lit("call( 12 )"))
    want = hashlib.sha256(b"R:a/b.js:call( # )").hexdigest()[:24]
    assert value(spark, text.fingerprint(*args)) == want


def test_finding_ids_use_the_last_bytes_only(spark):
    got = value(spark, text.finding_id(F.lit("R"), F.lit("é.js"), F.lit(7)))
    assert got == "R-" + "é.js:7".encode().hex()[-8:]
    got = value(spark, text.history_finding_id(F.lit("R"), F.lit("c" * 12), F.lit("a.js")))
    assert got == "R-HISTORY-" + ("c" * 12 + ":a.js").encode().hex()[-10:]


def test_redaction(spark):
    got = value(spark, text.redact(F.lit("""k = "abcdefghi", p = '123456', q = '1234567'""")))
    assert got == """k = "abcdef…redacted…", p = '123456', q = '123456…redacted…'"""
    assert len(value(spark, text.redact(F.lit("x" * 400)))) == 260


def test_prompt_redaction(spark):
    jwt = "eyJ" + "abc" + ".def" + ".ghi"
    pem = "-----BEGIN RSA " + "PRIVATE KEY-----\nx\n-----END RSA " + "PRIVATE KEY-----"
    raw = f"API_KEY: 'short' {jwt} AKIA{'A' * 16} {pem} gh" + "p_" + "a" * 20
    got = value(spark, prompts.redact_for_prompt(F.lit(raw)))
    assert got == (
        "API_KEY: '[REDACTED]' [REDACTED_TOKEN] [REDACTED_AWS_KEY] [REDACTED_PRIVATE_KEY] "
        "[REDACTED_TOKEN]"
    )


def test_replies_are_cleaned(spark):
    assert value(spark, prompts.clean_reply(F.lit(" <b>a</b>\x00\x07 b\tc\n "))) == "a b\tc"
    assert value(spark, prompts.clean_reply(F.lit("<p></p>"))) is None


def test_slugs(spark):
    ts = F.lit("1970-01-01T00:00:01.500Z").cast("timestamp")
    got = value(spark, slugs.branch_name("a b/c", F.lit("SEC_X-1" + "y" * 60), ts))
    assert got == "a-b/c-" + ("sec-x-1" + "y" * 60)[:48] + "-15o"
    assert value(spark, slugs.plan_path(".p", F.lit("a/b:c"))) == ".p/remediation-a-b-c.md"


def test_error_text(spark):
    assert value(spark, text.clean_error(F.lit("a\r\n\nb" + "c" * 600))) == "a b" + "c" * 497
