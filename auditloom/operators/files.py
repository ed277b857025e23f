"""File selection and reshaping of snapshot files into lines and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.topk import first_per_group, running_per_group

MAX_FILES = 2_500
MAX_BYTES = 50_000_000
MAX_FILE_BYTES = 512_000
WINDOW_LINES = 8
WINDOW_STRIDE = 4

# Directories that are never entered, scanned extensions, manifests.
IGNORED_DIRECTORIES = (
    ".git", "node_modules", "vendor", "coverage", ".next", "build", "dist",
)
TEXT_EXTENSIONS = (
    ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".json", ".yml", ".yaml", ".env",
    ".py", ".go", ".java", ".rb", ".php", ".html", ".vue", ".svelte",
)
MANIFEST_NAMES = (
    "Dockerfile", "Gemfile", "Gemfile.lock", "package-lock.json", "requirements.txt",
    "go.sum", "composer.lock", "Cargo.lock",
)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last dotted suffix of the base name; a name like ``.env`` has none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)\z", 1))


def walk_key(path: Column) -> Column:
    """Sorts like a depth-first walk: NUL is below every byte a name may hold."""
    return F.replace(path, F.lit("/"), F.lit("\u0000"))


def prune_directories(files: DataFrame) -> DataFrame:
    names = "|".join(n.replace(".", r"\.") for n in IGNORED_DIRECTORIES)
    return files.filter(~F.col("path").rlike(rf"(?:^|/)(?:{names})/"))


def eligible_files(files: DataFrame) -> DataFrame:
    """Regular text files and manifests outside the ignored directories."""
    wanted = extension(F.col("path")).isin(*TEXT_EXTENSIONS) | base_name(F.col("path")).isin(
        *MANIFEST_NAMES
    )
    return prune_directories(files.filter((F.col("entry_type") == "file") & wanted))


def limit_files(files: DataFrame, n: int | None = None) -> DataFrame:
    """First ``n`` eligible files of each snapshot in walk order, or all, then not numbered.

    Works on metadata; bring file contents back by joining on the path.
    """
    keyed = files.withColumn("walk", walk_key(F.col("path")))
    if n is None:
        return keyed.withColumn("file_ord", F.lit(None).cast("int"))
    return first_per_group(
        keyed, ["scan_id"], [F.col("walk")], n, salt_on=["path"], rank_col="file_ord"
    )


def apply_byte_budget(
    limited: DataFrame,
    max_bytes: int | None = None,
    max_file_bytes: int | None = None,
    numbered: bool = True,
) -> DataFrame:
    """Marks each limited file as taken, large or beyond the budget stop.

    Sizes are never negative, so the running total of the small files passes
    the budget exactly at the file where a sequential reader would stop. Numbered
    files are summed by a window, which holds at most the file limit's number of
    rows per snapshot; others over ranges of the walk. Without a budget every
    small file is taken and nothing is summed.
    """
    small = F.lit(True) if max_file_bytes is None else F.col("length") <= max_file_bytes
    if max_bytes is None:
        return limited.withColumns(
            {
                "running_bytes": F.lit(None).cast("long"),
                "within_budget": F.lit(True),
                "is_large": ~small,
                "taken": small,
            }
        )
    sized = limited.withColumn("_small", F.when(small, F.col("length")).otherwise(F.lit(0)))
    if numbered:
        walk = Window.partitionBy("scan_id").orderBy("file_ord").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        summed = sized.withColumn("running_bytes", F.coalesce(F.sum("_small").over(walk), F.lit(0)))
    else:
        summed = running_per_group(sized, ["scan_id"], ["walk"], "_small", "running_bytes")
    return (
        summed.drop("_small")
        .withColumn("within_budget", F.col("running_bytes") <= max_bytes)
        .withColumn("is_large", ~small)
        .withColumn("taken", small & F.col("within_budget"))
    )


def select_files(
    files: DataFrame,
    max_files: int | None = None,
    max_bytes: int | None = None,
    max_file_bytes: int | None = None,
) -> DataFrame:
    """Per-file verdicts over metadata columns only; content is not read."""
    metadata = eligible_files(files).select("scan_id", "path", "length")
    limited = limit_files(metadata, max_files)
    return apply_byte_budget(limited, max_bytes, max_file_bytes, numbered=max_files is not None)


def scan_volume(selected: DataFrame, max_files: int | None = None) -> DataFrame:
    """One row per snapshot: files, bytes, skipped files and truncation.

    ``last_walk`` is the last walk key a sequential reader would reach, or NULL
    when nothing was cut off.
    """
    counted = selected.groupBy("scan_id").agg(
        F.count_if("taken").alias("files_scanned"),
        F.coalesce(F.sum(F.when(F.col("taken"), F.col("length"))), F.lit(0)).alias(
            "bytes_scanned"
        ),
        F.count_if(F.col("is_large") & F.col("within_budget")).alias("skipped_large_files"),
        F.count(F.lit(1)).alias("_listed"),
        F.max(~F.col("within_budget")).alias("_over"),
        F.max(F.when(F.col("within_budget"), F.col("walk"))).alias("_last"),
    )
    full = F.lit(False) if max_files is None else F.col("_listed") >= max_files
    reason = F.when(F.col("_over"), "byte-limit").when(full, "file-limit")
    return counted.select(
        "scan_id",
        "files_scanned",
        "bytes_scanned",
        "skipped_large_files",
        reason.isNotNull().alias("truncated"),
        reason.alias("truncation_reason"),
        F.when(reason.isNotNull(), F.coalesce("_last", F.lit(""))).alias("last_walk"),
    )


def scanned_files(
    files: DataFrame, cuts: DataFrame, max_file_bytes: int | None = None
) -> DataFrame:
    """Eligible small files up to the cut of their snapshot, with content.

    ``cuts`` holds only the truncated snapshots (scan_id, last_walk). The result
    equals the ``taken`` rows of ``select_files`` without shuffling contents
    when the cuts are broadcast.
    """
    small = eligible_files(files)
    if max_file_bytes is not None:
        small = small.filter(F.col("length") <= max_file_bytes)
    keyed = small.withColumn("walk", walk_key(F.col("path")))
    return (
        keyed.join(cuts.select("scan_id", "last_walk"), "scan_id", "left")
        .filter(F.col("last_walk").isNull() | (F.col("walk") <= F.col("last_walk")))
        .drop("last_walk")
    )


def text_lines(content: Column) -> Column:
    return F.split(content, r"\r?\n", -1)


def window_texts(lines: Column, size: int = WINDOW_LINES, stride: int = WINDOW_STRIDE) -> Column:
    """Array of (line_no, text) windows that start at every ``stride``-th line."""
    starts = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(stride))
    return F.transform(
        starts,
        lambda i: F.struct(
            (i + 1).alias("line_no"),
            F.array_join(F.slice(lines, i + 1, F.lit(size)), "\n").alias("text"),
        ),
    )


def explode_lines(files: DataFrame) -> DataFrame:
    return files.select(
        "scan_id", F.col("path").alias("file"), F.posexplode(text_lines(F.col("content")))
    ).select("scan_id", "file", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


def line_windows(
    files: DataFrame, size: int = WINDOW_LINES, stride: int = WINDOW_STRIDE
) -> DataFrame:
    lines = files.select(
        "scan_id", F.col("path").alias("file"), text_lines(F.col("content")).alias("_lines")
    )
    return lines.select(
        "scan_id", "file", F.inline(window_texts(F.col("_lines"), size, stride))
    )
