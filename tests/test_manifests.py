"""Lock files and the joins over their dependencies."""

import json

import pytest

from tests.helpers import files_table
from auditloom.operators.dependencies import baseline_findings, default_baselines
from auditloom.operators.manifests import dependency_inventory


def inventory(spark, name, content, **options):
    rows = dependency_inventory(
        files_table(spark, [("s", f"dir/{name}", content)]), **options
    ).collect()
    return [(r.ecosystem, r.name, r.version) for r in sorted(rows, key=lambda r: r.pos)]


@pytest.mark.parametrize(
    ("name", "content", "want"),
    [
        ("requirements.txt", "numpy==1.26.4\ntqdm<5\n  a.b==1;x\r\n==3", [
            ("PyPI", "numpy", "1.26.4"), ("PyPI", "a.b", "1")]),
        ("go.sum", "example.com/lib/queue v1.9.2 h1:abc\nexample.com/lib/queue v1.9.2/go.mod h1:def", [
            ("Go", "example.com/lib/queue", "1.9.2")]),
        ("Gemfile.lock", "    puma (6.4.0)\n      dep (1)\n  no (2)", [("RubyGems", "puma", "6.4.0")]),
        ("Cargo.lock", 'name = "x"\n[[package]]\nname = "a"\nversion = "1"\n[[package]]\nname = "b"\n'
         '[[package]]\n version = "3"\n name = "c"\n name = "d"', [
             ("crates.io", "a", "1"), ("crates.io", "c", "3")]),
        ("composer.lock", json.dumps({
            "packages": [{"name": "a", "version": "v1"}, {"name": "x"}],
            "packages-dev": [{"name": "b", "version": "2"}]}), [
                ("Packagist", "a", "1"), ("Packagist", "b", "2")]),
        ("composer.lock", '{"packages": [', []),
        ("package-lock.json", "{not json", []),
        ("package-lock.json", "", []),
        ("Package-lock.json", '{"packages": {"a": {"version": "1"}}}', []),
    ],
)
def test_formats(spark, name, content, want):
    assert inventory(spark, name, content) == want


def test_npm_entries(spark):
    lock = {
        "packages": {
            "": {"version": "9"}, "node_modules/z": {"version": "1"}, "a": {"version": "2"},
            "node_modules/a/node_modules/b": {"version": "3"}, "odd": "text", "none": None,
            "number": {"version": 4}, "empty": {"version": ""},
        },
        "dependencies": {"unused": {"version": "1"}},
    }
    assert inventory(spark, "package-lock.json", json.dumps(lock)) == [
        ("npm", "z", "1"), ("npm", "a", "2"), ("npm", "a/node_modules/b", "3"), ("npm", "number", "4"),
    ]
    old = {"dependencies": {"d": {"version": "1"}}}
    assert inventory(spark, "package-lock.json", json.dumps(old)) == [("npm", "d", "1")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"packages": {"a": {"version": "1"}, "b": {"version": "3"}, "a": {"version": "2"}}}',
         [("npm", "a", "2"), ("npm", "b", "3")]),
        ('{"packages": {"a": {"version": "1"}}} trailing', []),
        ('{"packages": {"a": {"version": "1"}}}\n', [("npm", "a", "1")]),
        ('{"packages": {}, "dependencies": {"a": {"version": "1"}}}', []),
        ('{"packages": null, "dependencies": {"a": {"version": "1"}}}', [("npm", "a", "1")]),
        ("[]", []),
        ("5", []),
    ],
)
def test_npm_odd_documents(spark, text, want):
    assert inventory(spark, "package-lock.json", text) == want


def test_npm_limit_counts_usable_entries(spark):
    packages = {"": {}} | {f"p{i}": {"version": str(i)} for i in range(501)}
    text = json.dumps({"packages": packages})
    got = inventory(spark, "package-lock.json", text, npm_limit=500)
    assert len(got) == 500 and got[-1] == ("npm", "p499", "499")
    assert len(inventory(spark, "package-lock.json", text, npm_limit=None)) == 501


def test_baselines(spark):
    lock = json.dumps(
        {"packages": {f"node_modules/{n}": {"version": v} for n, v in
                      (("lodash", "4.17.20"), ("axios", "0.21.2"), ("minimist", "v1.2.5"))}}
    )
    table = dependency_inventory(files_table(spark, [("s", "package-lock.json", lock)]))
    rows = {r.rule: r for r in baseline_findings(table, default_baselines(spark)).collect()}
    assert set(rows) == {"DEP-LODASH", "DEP-MINIMIST"}
    assert rows["DEP-LODASH"].patch == [
        '- "lodash": "4.17.20"', '+ "lodash": "4.17.21" or newer',
    ]
    assert "CVE-2021-23337" in rows["DEP-LODASH"].explanation
