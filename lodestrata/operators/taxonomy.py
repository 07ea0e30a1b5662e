"""Import rules of concept taxonomies: repeated rows, unresolved links, labels and memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators import hierarchy


def keep_newest(df: DataFrame, key: str, version: str, row: str) -> DataFrame:
    """Of rows with one key that of the greatest ``version``, ties to the first ``row``."""
    order = F.struct(F.col(version), -F.col(row))
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("_w")).select("_w.*")


def differing_columns(df: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """``(key, rows, fields)`` of repeated keys, with the columns in which their rows differ; null counts as ''."""
    columns = [c for c in df.columns if c != key and c not in ignore]
    flags = [F.when(F.countDistinct(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) > 1, c) for c in columns]
    return df.groupBy(key).agg(F.count("*").alias("rows"), F.array_compact(F.array(*flags)).alias("fields")).where("rows > 1")


def resolve_links(links: DataFrame, ends: list[str], concepts: DataFrame, uri: str, kind: str) -> DataFrame:
    """The links with ``{end}_kind`` of each end, null where the concept isn't known."""
    known = concepts.select(F.col(uri).alias("_uri"), F.col(kind).alias("_kind")).where("_uri IS NOT NULL").dropDuplicates(["_uri"])
    for end in ends:
        links = links.join(known, F.col(end) == F.col("_uri"), "left").drop("_uri").withColumnRenamed("_kind", f"{end}_kind")
    return links


def link_problems(links: DataFrame, child: str, parent: str, declared: dict[str, str] | None = None) -> DataFrame:
    """One row of counts over resolved links: unresolved, type mismatches, self-loops and repeated pairs."""
    mismatch = F.lit(False)
    for end, column in (declared or {}).items():
        mismatch = mismatch | F.coalesce(F.col(f"{end}_kind") != F.col(column), F.lit(False))
    pairs = links.groupBy(child, parent).agg(
        F.count("*").alias("n"), F.max(F.col(f"{child}_kind").isNull() | F.col(f"{parent}_kind").isNull()).alias("lost"),
        F.sum(mismatch.cast("bigint")).alias("bad"),
    )
    return pairs.agg(
        F.coalesce(F.sum(F.when(F.col("lost"), F.col("n"))), F.lit(0)).alias("unresolved"), F.coalesce(F.sum("bad"), F.lit(0)).alias("type_mismatches"),
        F.coalesce(F.sum(F.when(F.col(child) == F.col(parent), F.col("n"))), F.lit(0)).alias("self_loops"), F.count_if(F.col("n") > 1).alias("repeated_pairs"),
    )


def has_cycle(links: DataFrame, child: str, parent: str) -> bool:
    _, clean = hierarchy.read_links(links, child, parent)
    return not hierarchy.cycle_nodes(clean).isEmpty()


def memberships(df: DataFrame, key: str, schemes: str) -> DataFrame:
    """``(key, scheme)`` of a column that lists URIs by lines or commas."""
    return df.select(key, F.explode(X.split_uris(F.col(schemes))).alias("scheme")).distinct()


def unknown_schemes(members: DataFrame, schemes: DataFrame, uri: str) -> DataFrame:
    """``(scheme, rows)`` of memberships whose scheme isn't known."""
    return members.join(schemes.select(F.col(uri).alias("scheme")), "scheme", "left_anti").groupBy("scheme").agg(F.count("*").alias("rows"))


def inverse(links: DataFrame, child: str, parent: str) -> DataFrame:
    """The links seen from above: ``(broader, narrower)``."""
    return links.select(F.col(parent).alias("broader"), F.col(child).alias("narrower"))


def path_links(df: DataFrame, levels: list[str]) -> DataFrame:
    """Distinct ``(child, parent)`` of neighbours in a row's levels from top to bottom; blank levels are skipped."""
    path = F.array_compact(F.array(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in levels]))
    pairs = df.select(path.alias("p")).where(F.size("p") > 1).select(F.explode(F.arrays_zip(F.slice("p", F.lit(2), F.size("p") - 1).alias("child"), F.slice("p", F.lit(1), F.size("p") - 1).alias("parent"))).alias("x"))
    return pairs.select("x.child", "x.parent").distinct()


def label_table(concepts: DataFrame, uri: str = "concept_uri") -> DataFrame:
    """``(uri, label, kind)``: preferred, alternative and hidden labels, trimmed, each once."""
    def of(column: str, kind: str) -> DataFrame:
        values = F.explode(column) if dict(concepts.dtypes)[column].startswith("array") else F.col(column)
        return concepts.select(uri, values.alias("l")).select(uri, X.collapse(F.col("l")).alias("label"), F.lit(kind).alias("kind"))

    return of("preferred_label", "preferred").unionByName(of("alt_labels", "alternative")).unionByName(of("hidden_labels", "hidden")).where("label <> ''").distinct()


#: Types that concepts may have.
CONCEPT_TYPES = ("KnowledgeSkillCompetence", "SkillGroup", "ConceptScheme")


def concept_problems(concepts: DataFrame, uri: str = "concept_uri", kind: str = "concept_type", label: str = "preferred_label", kinds: tuple[str, ...] = CONCEPT_TYPES) -> DataFrame:
    """``(uri, problem)`` of concepts with an unknown type, a URI that isn't one, or without a label; one row for each rule that a row breaks."""
    c = F.col
    bad = lambda test, text: F.when(~F.coalesce(test, F.lit(False)), text)
    rules = F.array_compact(F.array(
        bad(c(kind).isin(*kinds), "unknown type"), bad(c(uri).rlike(r"^https?://\S+$"), "no URI"), bad(F.trim(c(label)) != "", "no label"),
    ))
    return concepts.select(uri, F.explode(rules).alias("problem"))


def label_mismatches(links: DataFrame, end: str, given: str, concepts: DataFrame, uri: str, label: str) -> DataFrame:
    """One row: how many different labels links give to concepts of ``concepts``, and how many of them aren't the concepts' own."""
    own = concepts.groupBy(uri).agg(F.max(label).alias("_own"))
    named = links.where(F.col(given).isNotNull() & F.col(end).isNotNull()).select(F.col(end).alias(uri), F.col(given).alias("_given")).distinct()
    return named.join(own, uri).agg(F.count("*").alias("labels"), F.coalesce(F.sum((F.col("_given") != F.col("_own")).cast("bigint")), F.lit(0)).alias("mismatches"))


def import_summary(concepts: DataFrame, by: list[str], lists: list[str]) -> DataFrame:
    """``(by, concepts, list elements..., without_labels)``: what an import brings, and rows that a warning is due for."""
    without = F.count_if(F.coalesce(F.trim("preferred_label"), F.lit("")) == "")
    return concepts.groupBy(*by).agg(F.count("*").alias("concepts"), *[F.sum(F.size(c)).cast("bigint").alias(c) for c in lists], without.alias("without_labels"))


def import_taxonomy(concepts: DataFrame, links: DataFrame, path: str, version: str, language: str, digest: str, kinds: tuple[str, ...] = CONCEPT_TYPES) -> dict[str, int] | None:
    """Import concepts and their ``(child, parent)`` links, all or none (see ``loading.import_tables``).

    Before anything is written, concepts must meet their rules and be one row a URI; links must have
    known ends, and none may be a loop, stand twice or close a cycle.
    """
    from lodestrata.operators import checks, loading

    ends = links.select(F.explode(F.array("child", "parent")).alias("end")).distinct()
    problems = {
        "concepts break a rule": concept_problems(concepts, kinds=kinds),
        "concepts stand twice": checks.duplicate_keys(concepts, ["concept_uri"]),
        "links of unknown concepts": checks.missing_references(ends, "end", concepts, "concept_uri"),
        "links stand twice": checks.duplicate_keys(links, ["child", "parent"]),
        "links make a cycle": hierarchy.cycle_nodes(links.select("child", "parent")),
    }
    return loading.import_tables({"concepts": concepts, "links": links, "labels": label_table(concepts)}, path, version, language, digest, problems)
