"""Aggregates of corpus analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import is_missing


def reason_counts(df: DataFrame, reason: str = "exclusion_reason") -> DataFrame:
    """``(reason, rows)``: each reason of the semicolon lists, placeholder kinds as one; usable rows as 'usable'."""
    one = F.explode(F.split(F.when(F.col(reason) == "", "usable").otherwise(F.col(reason)), ";"))
    bare = F.when(F.col("r").startswith("placeholder_"), "placeholder").otherwise(F.col("r"))
    return df.select(one.alias("r")).groupBy(bare.alias("reason")).agg(F.count("*").alias("rows"))


def repeated_groups(df: DataFrame, keys: list[str], digest: str, name: str, label: str) -> DataFrame:
    """Groups of ``keys`` with more than one digest: rows, different digests and ``label`` values in the order of ``name``.

    Only the groups' own rows are listed together, after groups of one text are out.
    """
    many = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.countDistinct(digest).alias("texts")).where("texts > 1")
    listed = df.join(many.select(*keys), keys, "left_semi").groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, F.coalesce(label, F.lit("")).alias("l")))), lambda x: x["l"]), " | ").alias(f"{label}s")
    )
    return many.join(listed, keys)


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, n, upper_median)``: the middle value of each group, of an even number the upper one.

    By counts of distinct values, which are combined before the shuffle, not by listing all rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key)
    running = F.sum("c").over(w.orderBy(value))
    total = F.sum("c").over(w)
    return (
        counts.select(key, value, running.alias("upto"), total.alias("n"))
        .where(F.col("upto") > F.floor(F.col("n") / 2))
        .groupBy(key).agg(F.max("n").alias("n"), F.min(value).alias("upper_median"))
    )


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(by, n, median)``: the linear median of each group."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.median(value).alias("median"))


def rates(df: DataFrame, flags: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """``(by, rows, name...)``: the share of rows for which each flag holds; a null flag counts as no row."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("rows"), *[F.avg(c.cast("double")).alias(n) for n, c in flags.items()])


def pair_counts(pairs: DataFrame, by: list[str], alike: Column, similarity: str) -> DataFrame:
    """``(by, pairs, alike, least)``: how many pairs, how many of them alike, and the least similarity."""
    return pairs.groupBy(*by).agg(F.count("*").alias("pairs"), conditional("alike", alike), F.min(similarity).alias("least"))


def describe(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and linear percentiles."""
    v = F.col(value)
    return df.groupBy(*(by or [])).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        *[F.percentile(v, p / 100).alias(f"p{p}") for p in (10, 25, 50, 75, 90)], F.max(v).alias("max"),
    )


def concentration(df: DataFrame, key: str, top: int = 2) -> DataFrame:
    """One row: total, the sum of squared group sizes (the index is their ratio to total squared) and the rows of the largest groups."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    largest = sizes.orderBy(F.desc("n"), key).limit(top).agg(F.sum("n").alias("top_rows"))
    return sizes.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("groups")).crossJoin(largest)


def missing_rates(df: DataFrame) -> DataFrame:
    """``(column, missing, rows)`` of every column, in one pass."""
    kinds = dict(df.dtypes)
    one = df.agg(F.count("*").alias("_rows"), *[F.count_if(is_missing(F.col(f"`{c}`"), kinds[c])).alias(c) for c in df.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing")) for c in df.columns]))
    return one.select(pairs.alias("p"), F.col("_rows").alias("rows")).select("p.column", "p.missing", "rows")


def value_counts(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """``(value, rows)`` of a column or of an array's elements, nulls left out; the ``most`` frequent, ties by value."""
    value = F.explode(column) if dict(df.dtypes)[column].startswith("array") else F.col(column)
    counts = df.select(value.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("rows"))
    return counts.orderBy(F.desc("rows"), "value").limit(most) if most else counts


def distinct_elements(df: DataFrame, key: str, array: str) -> DataFrame:
    """``(key, elements)``: how many different elements the arrays of each group hold."""
    return df.select(key, F.explode_outer(array).alias("e")).groupBy(key).agg(F.countDistinct("e").alias("elements"))


def zero_filled(counts: DataFrame, labels: list[str], key: str, value: str) -> DataFrame:
    """The counts for all labels, 0 for those that don't occur."""
    known = counts.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], f"position int, `{key}` string")
    return known.join(counts, key, "left").select(key, "position", F.coalesce(value, F.lit(0)).cast("bigint").alias(value))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, b, rows)`` with margins: rows with 'All' in one or both."""
    filled = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in (a, b)])
    return filled.cube(a, b).agg(F.count("*").alias("rows"), F.grouping(a).alias("_a"), F.grouping(b).alias("_b")).select(
        F.when(F.col("_a") == 1, "All").otherwise(F.col(a)).alias(a), F.when(F.col("_b") == 1, "All").otherwise(F.col(b)).alias(b), "rows"
    )


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """``(bin, rows)`` for the intervals (edge, next], the first with its lower edge; values outside are left out, empty bins are 0."""
    v, found = F.col(value), F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        low = v >= edges[i] if i == 0 else v > edges[i]
        found = F.when(low & (v <= edges[i + 1]), i).otherwise(found)
    counts = df.select(found.alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("rows"))
    return df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"))


def share_of_total(counts: DataFrame, value: str) -> DataFrame:
    """Adds ``share`` = value / total. One total is computed and joined, since a window without partition would gather all rows."""
    total = counts.agg(F.sum(value).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col(value) / F.col("_total")).drop("_total")


def language_share(parts: DataFrame, key: str, lang: str, words: str) -> DataFrame:
    """``(key, lang, words, total)``: the language of most words of each key, ties by name."""
    sums = parts.groupBy(key, lang).agg(F.sum(words).alias("w"))
    best = F.min(F.struct(-F.col("w"), F.col(lang).alias("l")))
    return sums.groupBy(key).agg(best.alias("b"), F.sum("w").alias("total")).select(key, F.col("b.l").alias(lang), (-F.col("b.col1")).alias(words), "total")


def as_metrics(df: DataFrame, name: str = "metrics") -> DataFrame:
    """One row's columns as a JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def digest_of(df: DataFrame, name: str, sha: str) -> DataFrame:
    """One SHA-256 over the sorted names and hashes of a file list. One value of one text: lists of files are small by nature, other tables shouldn't be digested so."""
    lines = F.array_sort(F.collect_list(F.concat_ws("\t", name, sha)))
    return df.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(facet, value)``: the different non-empty values of each column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL AND value <> ''").distinct()


def conditional(name: str, condition: Column) -> Column:
    return F.count_if(condition).alias(name)
