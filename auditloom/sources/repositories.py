"""Repository addresses and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import trim_space

MAX_REPOSITORY_KB = 250_000
HOST = "github.com"

# Messages of refused addresses and repositories.
NOT_A_URL = "Enter a valid GitHub repository URL."
WRONG_HOST = "Only HTTPS github.com repository URLs are supported."
WRONG_PATH = "Use a repository URL in the form https://github.com/owner/repository."
ARCHIVED = "Archived repositories are disabled by policy."

# scheme, host, port, path of an address; user names, queries and fragments are skipped.
_WEB = r"(?i)\A(https?|wss?|ftp):[/\\]*(?:[^/\\?#]*@)?([^/\\?#:@\s<>^|%]+)(?::([0-9]{0,5}))?([/\\][^?#]*)?(?:[?#][\s\S]*)?\z"
_OTHER = r"(?i)\A[a-z][a-z0-9+.-]*:"


def _resolved(path: Column) -> Column:
    """Path segments without empty ones, ``.`` and ``..`` resolved."""
    segments = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: s != "")
    return F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )


def parse_repository_urls(df: DataFrame, col: str) -> DataFrame:
    """Adds owner, repository, clone_url, web_url and reject_reason."""
    url = F.translate(trim_space(F.coalesce(F.col(col), F.lit(""))), "\t\r\n", "")
    is_web = url.rlike(_WEB)
    port = F.regexp_extract(url, _WEB, 3)
    valid = (is_web & ((port == "") | (port.cast("int") <= 65_535))) | (
        url.rlike(_OTHER) & ~url.rlike(r"(?i)\A(https?|wss?|ftp):")
    )
    scheme = F.lower(F.regexp_extract(url, _WEB, 1))
    host = F.lower(F.regexp_extract(url, _WEB, 2))
    path = F.regexp_extract(url, _WEB, 4)
    ends_in_slash = path.rlike(r"[/\\]\z")
    segments = _resolved(path)
    joined = F.concat(
        F.array_join(segments, "/"), F.when(ends_in_slash, F.lit("/")).otherwise(F.lit(""))
    )
    parts = F.filter(
        F.split(F.regexp_replace(joined, r"\.git\z", ""), "/"), lambda s: s != ""
    )
    staged = df.withColumn("_ok", valid & (scheme == "https") & (host == HOST)).withColumn(
        "_parts", F.when(F.col("_ok"), parts)
    )
    good_parts = (F.size("_parts") == 2) & F.forall(
        "_parts", lambda p: p.rlike(r"\A[A-Za-z0-9_.-]+\z")
    )
    reason = (
        F.when(~valid, NOT_A_URL)
        .when(~F.col("_ok"), WRONG_HOST)
        .when(~good_parts, WRONG_PATH)
    )
    accepted = F.col("reject_reason").isNull()
    web = F.concat(F.lit(f"https://{HOST}/"), F.array_join("_parts", "/"))
    return (
        staged.withColumn("reject_reason", reason)
        .withColumn("owner", F.when(accepted, F.get("_parts", F.lit(0))))
        .withColumn("repository", F.when(accepted, F.get("_parts", F.lit(1))))
        .withColumn("clone_url", F.when(accepted, F.concat(web, F.lit(".git"))))
        .withColumn("web_url", F.when(accepted, web))
        .drop("_ok", "_parts")
    )


def admission_reason(max_kb: int, allow_archived: bool) -> Column:
    """Why a repository is refused, size first; NULL when it is admitted."""
    size = F.coalesce("size_kb", F.lit(0))
    too_big = F.concat(
        F.lit("Repository size "),
        size.cast("string"),
        F.lit(f" KB exceeds the configured {max_kb} KB limit."),
    )
    reason = F.when(size > max_kb, too_big)
    if not allow_archived:
        reason = reason.when(F.coalesce("archived", F.lit(False)), ARCHIVED)
    return reason


def admit_repositories(
    repos: DataFrame, max_kb: int = MAX_REPOSITORY_KB, allow_archived: bool = False
) -> DataFrame:
    return repos.filter(admission_reason(max_kb, allow_archived).isNull())
