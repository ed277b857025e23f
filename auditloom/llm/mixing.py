"""Mixing sources to target weights by entropy balancing.

Targets share all words by weight, with a ceiling per source. Inside a source the document rates
closest to 1 in relative entropy that meet the word target are exponentials of the document's
size, ``min(most, exp(l * size / mean))``. The duals ``l`` of all sources are found together by
Newton steps; each step is one aggregation over the histogram (source, size, documents), from
which rates depend alone. Rates are then rounded into copies, long documents first, each size
taking over what the sizes before it left over or took too much.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import staged

WORDS = r"[^\x20\x09-\x0D]+"
STEPS = 60
CLOSE = 1e-9


def word_count(text: str) -> Column:
    """Runs of characters other than the six white space characters; null has none."""
    spaced = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    trimmed = F.trim(spaced)
    return F.when(trimmed == "", F.lit(0)).otherwise(
        F.size(F.split(trimmed, " +"))
    ).cast("long")


def targets(sizes: DataFrame, weights: list[float], most: float) -> DataFrame:
    """Adds ``target`` to rows (source, source_size), one per source.

    Weights go round the sources by code point, null last. The level at which
    ``min(most * size, level * weight)`` adds up to all words is found from running sums over
    the sources sorted by the level at which they stop. One row per source goes through the
    window, never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_r", F.row_number().over(order) - 1).withColumn(
        "_w", F.element_at(cycle, (F.col("_r") % len(weights) + 1).cast("int"))
    )
    ranked = ranked.withColumn("_stop", F.lit(float(most)) * F.col("source_size"))
    by_stop = Window.orderBy(F.col("_stop") / F.col("_w"), "_r")
    upto = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    held = ranked.withColumns({
        "_all": F.sum("source_size").over(every).cast("double"),
        "_stopped": F.coalesce(F.sum("_stop").over(upto), F.lit(0.0)),
        "_open": F.sum("_w").over(rest),
    })
    held = held.withColumn("_level", (F.col("_all") - F.col("_stopped")) / F.col("_open"))
    # the first source that does not stop at its own level fixes it for all that follow
    fits = F.col("_level") * F.col("_w") <= F.col("_stop")
    held = held.withColumn(
        "_level", F.first(F.when(fits, F.col("_level")), ignorenulls=True).over(by_stop.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))
    )
    return held.select(
        "source", "source_size",
        F.least(F.col("_stop"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_stop"))).alias("target"),
    )


def balanced(histogram: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """Rows (source, dual): Newton steps on the convex duals of all sources at once.

    ``histogram`` has (source, size, n), ``goals`` (source, source_size, target). Each step sums
    words and their derivative per source; a bracket kept per source replaces steps that leave
    it. A source whose target is its ceiling has no finite dual and gets null: all its
    documents are taken ``most`` times.
    """
    mean = histogram.groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean")
    )
    mean = mean.withColumnRenamed("source", "_s")
    state = goals.join(mean, F.col("source").eqNullSafe(F.col("_s"))).select(
        "source", "target", "mean",
        (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("dual"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"),
    )
    state = staged(state, "duals")
    for _ in range(STEPS):
        h = histogram.join(
            state.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
        ).where("not full and size > 0")
        z = F.col("size") / F.col("mean")
        free = F.col("dual") * z < F.lit(float(np.log(most)))
        rate = F.when(free, F.exp(F.col("dual") * z)).otherwise(F.lit(float(most)))
        words = F.col("n") * F.col("size") * rate
        sums = h.groupBy("_s").agg(
            F.sum(words).alias("got"), F.sum(F.when(free, words * z).otherwise(0.0)).alias("slope")
        )
        step = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left").withColumns({
            "off": F.col("target") - F.col("got"),
        }).withColumns({
            "low": F.when(F.col("off") > 0, F.col("dual")).otherwise(F.col("low")),
            "high": F.when(F.col("off") < 0, F.col("dual")).otherwise(F.col("high")),
        })
        newton = F.col("dual") + F.when(F.col("slope") > 0, F.col("off") / F.col("slope"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        middle = F.when(F.col("low") <= -1e6, F.col("dual") * 2 - 1).when(
            F.col("high") >= 1e6, F.col("dual") * 2 + 1
        ).otherwise((F.col("low") + F.col("high")) / 2)
        near = F.coalesce(F.abs("off") <= CLOSE * F.greatest("target", F.lit(1.0)), F.lit(True))
        state = staged(
            step.select(
                "source", "target", "mean", "full",
                F.when(near, F.col("dual")).otherwise(
                    F.when(inside, F.least(newton, F.col("dual") + 4)).otherwise(middle)
                ).alias("dual"),
                "low", "high", near.alias("near"),
            ),
            "duals",
        )
        if state.where("not near and not full").isEmpty():
            break
        state = state.drop("near")
    return state.select("source", "mean", F.when(~F.col("full"), F.col("dual")).alias("dual"))


def copies_of_sizes(rated: DataFrame, most: int) -> DataFrame:
    """Rows (source, size, n, rate) with ``copies`` (long): copies of all documents of that
    source and size together.

    One group holds the sizes of a source, a histogram without documents: its length is at most
    the number of different sizes.
    """

    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False, kind="stable").reset_index(drop=True)
        owed, out = 0.0, []
        for size, n, rate in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist()):
            owed += size * n * rate
            c = round(owed / size) if size else round(n * rate)
            c = min(max(c, 0), most * n)
            owed -= c * size
            out.append(c)
        return pdf[["source", "size", "n"]].assign(copies=np.array(out, np.int64))

    return rated.groupBy("source").applyInPandas(
        rounded, "source string, size long, n long, copies long"
    )


def mix(docs: DataFrame, weights: list[float], most: int = 3, key: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """Documents with size, source_size, target, copies and taken (copies times size).

    Null sources form one source; null and empty texts have size 0, take no words and one copy.
    Rows equal in key and text get the same number of copies. Input columns of the new names are
    replaced. The extra copies of a size go to the documents with the smallest hash of key and
    text; they are ranked in hash buckets, so no task sorts all documents of a size.
    """
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    base = docs.select(*keep, word_count(text).alias("size"))
    narrow = staged(
        base.select(
            F.col(source).alias("source"), "size", F.xxhash64(F.col(key), F.col(text)).alias("_h")
        ).groupBy("source", "size", "_h").agg(F.count("*").alias("_same")),
        "sizes",
    )
    histogram = staged(narrow.groupBy("source", "size").agg(F.sum("_same").alias("n")), "histogram")
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = staged(targets(sizes, weights, most), "targets")
    duals = balanced(histogram, goals, most)
    rated = histogram.join(
        duals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
    ).select(
        "source", "size", "n",
        F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.coalesce(F.least(
            F.lit(float(most)), F.exp(F.least(F.lit(700.0), F.col("dual") * F.col("size") / F.col("mean")))
        ), F.lit(float(most)))).alias("rate"),
    )
    whole = copies_of_sizes(rated, most)
    plan = staged(
        whole.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .select(F.col("source").alias("_source"), F.col("size").alias("_size"), "n", "copies",
                "source_size", "target"),
        "copies",
    )
    # extra copies go by hash rank: whole buckets below the limit, a ranked part of one bucket
    bucketed = narrow.withColumn("_b", F.shiftrightunsigned("_h", 54).cast("int"))
    counts = bucketed.groupBy("source", "size", "_b").agg(F.sum("_same").alias("_m"))
    upto = Window.partitionBy("source", "size").orderBy("_b").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_m").over(upto), F.lit(0)))
    edge = starts.join(
        plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    ).select(
        "source", "size", "_b", "_m", "_before", "source_size", "target",
        F.expr("copies div n").alias("_each"), F.expr("copies % n").alias("_extra"),
    )
    inside = Window.partitionBy("source", "size", "_b").orderBy("_h").rowsBetween(
        Window.unboundedPreceding, -1)
    ranked = bucketed.withColumn("_rank", F.coalesce(F.sum("_same").over(inside), F.lit(0)))
    e = edge.select(F.col("source").alias("_es"), F.col("size").alias("_ez"), F.col("_b").alias("_eb"),
                    "_before", "_each", "_extra", "source_size", "target")
    given = ranked.join(
        e, F.col("source").eqNullSafe(F.col("_es")) & (F.col("size") == F.col("_ez"))
        & (F.col("_b") == F.col("_eb"))
    ).select(
        F.col("source").alias("_gs"), F.col("size").alias("_gz"), F.col("_h").alias("_gh"), "_each",
        F.least(F.greatest(F.col("_extra") - F.col("_before") - F.col("_rank"), F.lit(0)),
                F.col("_same")).alias("_more"), "_same", "source_size", "target",
    )
    # rows equal in key and text share a hash and so get the same number of copies
    given = staged(given, "given")
    dealt = base.withColumn("_h", F.xxhash64(F.col(key), F.col(text)))
    joined = dealt.join(
        given, F.col(source).eqNullSafe(F.col("_gs")) & (F.col("size") == F.col("_gz"))
        & (F.col("_h") == F.col("_gh"))
    )
    split = F.when(F.col("_more") * 2 >= F.col("_same"), F.lit(1)).otherwise(F.lit(0))
    return joined.withColumn("copies", F.col("_each") + split).withColumn(
        "taken", F.col("copies") * F.col("size")
    ).select(*keep, "size", "source_size", "target", "copies", "taken")
