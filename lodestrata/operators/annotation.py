"""Evidence spans: placing, checking, comparing and drawing them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as X


def check_spans(spans: DataFrame, texts: DataFrame, keys: list[str], text: str = "clean_text") -> DataFrame:
    """The spans with ``span_ok``: whether the text holds the evidence there; false where the text is missing."""
    joined = spans.join(texts.select(*keys, F.col(text).alias("_text")), keys, "left")
    return joined.withColumn("span_ok", X.span_holds(F.col("_text"), F.col("evidence_start"), F.col("evidence_end"), F.col("evidence_text"))).drop("_text")


#: Why a stated item isn't accepted, and why an alternative group doesn't hold.
NO_STATEMENT, STATED_BEFORE = "empty skill_statement", "duplicate skill_statement in this posting"
NO_GROUP = {"small": "fewer than two members", "mixed": "members have different requirement_status", "example": "contains illustrative examples"}
GROUP_DROPPED = ("alternative group '", "' dropped: ")


def statement_rows(output: DataFrame, key: str, text: str, skills: str) -> DataFrame:
    """One row for each item of a model's output, placed in the text: ``start, end, resolution, reason``.

    ``reason`` is null for accepted items; else the statement is empty, its evidence can't be
    placed, or an earlier accepted item of the same row states the same. ``ordinal`` numbers the
    accepted ones from 0. One shuffle by the row's key; a row's items are few.
    """
    flat = output.select(key, F.col(text).alias("_text"), F.posexplode(skills).alias("model_index", "s")).select(
        key, "model_index", F.trim("s.skill_statement").alias("statement"), "s.evidence_text", F.col("s.requirement_status").alias("requirement_status"),
        F.col("s.mention_relation").alias("mention_relation"), F.trim("s.alternative_group").alias("alternative_group"),
        X.resolve_evidence(F.col("_text"), F.col("s.evidence_text"), F.col("s.evidence_context")).alias("r"),
    )
    first = flat.withColumn("reason", F.when(F.coalesce("statement", F.lit("")) == "", NO_STATEMENT).otherwise(F.col("r.reason")))
    same = Window.partitionBy(key, F.lower("statement"), F.col("reason").isNull()).orderBy("model_index")
    judged = first.withColumn("reason", F.coalesce("reason", F.when(F.row_number().over(same) > 1, STATED_BEFORE)))
    order = Window.partitionBy(key).orderBy("model_index")
    ordinal = F.count_if(F.col("reason").isNull()).over(order) - 1
    return judged.select(
        key, "model_index", "statement", "evidence_text", "requirement_status", "mention_relation", F.nullif("alternative_group", F.lit("")).alias("alternative_group"),
        F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.col("r.resolution").alias("resolution"), "reason",
        F.when(F.col("reason").isNull(), ordinal).alias("ordinal"),
    )


def drop_bad_alternatives(rows: DataFrame, key: str) -> DataFrame:
    """Nulls ``alternative_group`` where the group has under two members, several requirements or an illustrative example, with a ``warning``."""
    groups = rows.where("alternative_group IS NOT NULL").groupBy(key, "alternative_group").agg(
        F.count("*").alias("n"), F.countDistinct(F.coalesce("requirement_status", F.lit(""))).alias("r"), F.max(F.col("mention_relation") == "illustrative_example").alias("e")
    )
    problem = F.when(F.col("n") < 2, NO_GROUP["small"]).when(F.col("r") > 1, NO_GROUP["mixed"]).when(F.col("e"), NO_GROUP["example"])
    bad = groups.select(key, "alternative_group", problem.alias("_p")).where("_p IS NOT NULL")
    joined = rows.join(bad, [key, "alternative_group"], "left")
    return joined.withColumn("warning", F.when(F.col("_p").isNotNull(), F.concat(F.lit(GROUP_DROPPED[0]), "alternative_group", F.lit(GROUP_DROPPED[1]), "_p"))).withColumn(
        "alternative_group", F.when(F.col("_p").isNull(), F.col("alternative_group"))
    ).drop("_p")


def alternative_problems(rows: DataFrame) -> DataFrame:
    """``(alternative_group_id, members, postings, requirements)`` of groups that are too small, span postings or mix requirements."""
    groups = rows.where(F.coalesce("alternative_group_id", F.lit("")) != "").groupBy("alternative_group_id").agg(
        F.count("*").alias("members"), F.countDistinct("posting_id").alias("postings"), F.countDistinct("required_or_preferred").alias("requirements")
    )
    return groups.where("members < 2 OR postings > 1 OR requirements > 1")


def annotation_summary(spans: DataFrame) -> DataFrame:
    """Counters for each annotator; repeated deliveries count once."""
    rows = spans.dropDuplicates(["annotation_id"])
    blank = F.coalesce(F.trim("skill_statement"), F.lit("")) == ""
    return rows.groupBy("annotator_id").agg(
        F.count("*").alias("annotations"), F.countDistinct("posting_id").alias("postings"), F.count_if(F.col("required_or_preferred") == "required").alias("required"),
        F.count_if(F.col("required_or_preferred") == "preferred").alias("preferred"), F.count_if(blank).alias("blank_statements"), F.count_if(F.col("evidence_text").isNull()).alias("without_evidence"),
    )


def match_spans(a: DataFrame, b: DataFrame, key: str = "posting_id") -> DataFrame:
    """``(key, kind, a_id, b_id)`` of two annotators' spans ``(key, id, start, end)``: ``exact``, ``overlap``, ``only_a`` or ``only_b``.

    Spans of one text are matched one to one in their order: an equal span if it is free, else the
    last free one that overlaps. A text's spans are few, so they are matched in one group.
    """
    def run(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        free, rows = list(other.sort_values(["start", "end", "id"]).itertuples(index=False)), []
        name = (own if len(own) else other)[key].iloc[0]
        for x in own.sort_values(["start", "end", "id"]).itertuples(index=False):
            over = [y for y in free if y.start < x.end and x.start < y.end]
            equal = [y for y in over if (y.start, y.end) == (x.start, x.end)]
            hit = equal[0] if equal else over[-1] if over else None
            if hit is not None:
                free.remove(hit)
            rows.append((name, "only_a" if hit is None else "exact" if equal else "overlap", x.id, None if hit is None else hit.id))
        rows += [(name, "only_b", None, y.id) for y in free]
        return pd.DataFrame(rows, columns=[key, "kind", "a_id", "b_id"])

    columns = [key, "id", "start", "end"]
    return a.select(*columns).groupBy(key).cogroup(b.select(*columns).groupBy(key)).applyInPandas(run, f"`{key}` string, kind string, a_id string, b_id string")


def agreement(matches: DataFrame) -> DataFrame:
    """Counts of the kinds and the overlap F1 = 2m / (na + nb), null without spans."""
    counts = matches.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("exact", "overlap", "only_a", "only_b")])
    m = F.col("exact") + F.col("overlap")
    return counts.withColumn("overlap_f1", F.round(F.try_divide(2 * m, 2 * m + F.col("only_a") + F.col("only_b")), 4))


def segments(spans: DataFrame, texts: DataFrame, keys: list[str], text: str = "clean_text") -> DataFrame:
    """``(keys, start, end, ids)``: the text cut at all span ends, each piece with the spans that cover it.

    The pieces of a text follow one another and make the whole text. Spans outside their text are
    left out; a text without spans is one piece; an empty text has none.
    """
    lengths = texts.select(*keys, F.length(text).alias("_n")).where("_n > 0")
    inside = spans.join(lengths, keys).where("start >= 0 AND start < end AND end <= _n")
    ends = inside.select(*keys, F.explode(F.array("start", "end")).alias("at")).unionByName(lengths.select(*keys, F.explode(F.array(F.lit(0), F.col("_n"))).alias("at"))).distinct()
    w = Window.partitionBy(*keys).orderBy("at")
    pieces = ends.select(*keys, F.col("at").alias("_from"), F.lead("at").over(w).alias("_to")).where("_to IS NOT NULL")
    covered = pieces.join(inside.select(*keys, "id", "start", "end"), keys, "left").groupBy(*keys, "_from", "_to").agg(
        F.array_sort(F.collect_set(F.when((F.col("start") <= F.col("_from")) & (F.col("_to") <= F.col("end")), F.col("id")))).alias("ids")
    )
    return covered.select(*keys, F.col("_from").alias("start"), F.col("_to").alias("end"), "ids")


#: What annotation fields may hold.
REQUIREMENTS = ("required", "preferred", "unclear")
STATUSES = ("not_started", "in_progress", "reviewed")
CATEGORIES = ("technical", "soft", "language", "domain")


def annotation_problems(skills: DataFrame, texts: DataFrame, selected: DataFrame | None = None, snapshot_id: str | None = None, requirements: tuple[str, ...] = REQUIREMENTS, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """``(annotation_id, field, problem)`` of annotation rows, one for each rule that a row breaks.

    Rules: a posting of the selection and snapshot (where given), an id that is there and used once,
    a statement, a known requirement and category, an annotator, offsets within the text, the text
    there, no blanks at its ends, no statement and span twice, and an alternative group that is well
    formed, has two members at least, all of one posting and requirement and of different skills. A row
    whose posting has no text is checked for everything but its span; columns that the table lacks
    aren't checked. Where rows have a ``source_row``, it comes with the problem.
    """
    rows = skills.join(texts.select("snapshot_id", "posting_id", F.col("clean_text").alias("_text")), ["snapshot_id", "posting_id"], "left")
    if selected is not None:
        rows = rows.join(selected.select("posting_id", F.lit(True).alias("_selected")).distinct(), "posting_id", "left")
    c = F.col
    uses = Window.partitionBy("annotation_id")
    spans = Window.partitionBy("snapshot_id", "posting_id", "evidence_start", "evidence_end", F.lower(F.trim("skill_statement")))
    blank = lambda n: F.coalesce(F.trim(c(n)), F.lit("")) == ""
    inside = (c("evidence_start") >= 0) & (c("evidence_start") < c("evidence_end")) & (c("evidence_end") <= F.length("_text"))
    counted = rows.withColumn("_uses", F.count("*").over(uses)).withColumn("_spans", F.count("*").over(spans))
    rules = [
        ("posting_id", c("_selected").isNull() if selected is not None else F.lit(False), "not selected"),
        ("snapshot_id", c("snapshot_id") != snapshot_id if snapshot_id else F.lit(False), "another snapshot"),
        ("annotation_id", blank("annotation_id"), "empty"), ("annotation_id", ~blank("annotation_id") & (c("_uses") > 1), "used more than once"),
        ("skill_statement", blank("skill_statement"), "empty"), ("annotator_id", blank("annotator_id"), "empty"),
        ("required_or_preferred", ~F.coalesce(c("required_or_preferred").isin(*requirements), F.lit(False)), "unknown value"),
        ("alternative_group_id", ~blank("alternative_group_id") & ~c("alternative_group_id").rlike(r"^[A-Za-z0-9_.-]{1,40}$"), "malformed"),
        ("evidence_start", c("_text").isNotNull() & ~F.coalesce(inside, F.lit(False)), "outside the text"),
        ("evidence_text", inside & ~X.span_holds(c("_text"), c("evidence_start"), c("evidence_end"), c("evidence_text")), "not at its place"),
        ("evidence_text", inside & (c("evidence_text") != F.trim("evidence_text")), "blanks at its ends"),
        ("skill_statement", ~blank("skill_statement") & c("evidence_start").isNotNull() & (c("_spans") > 1), "recorded twice for a span"),
    ]
    if "skill_category" in skills.columns:
        rules.append(("skill_category", ~blank("skill_category") & ~c("skill_category").isin(*categories), "unknown value"))
    has_group = ~blank("alternative_group_id")
    groups = rows.where(has_group).groupBy("alternative_group_id").agg(
        F.count("*").alias("_n"), F.countDistinct("posting_id").alias("_postings"), F.countDistinct(F.coalesce("required_or_preferred", F.lit(""))).alias("_requirements"),
        F.countDistinct(F.lower(F.trim("skill_statement"))).alias("_skills"), F.count("skill_statement").alias("_stated"),
    )
    counted = counted.join(groups, "alternative_group_id", "left")
    rules += [
        ("alternative_group_id", has_group & (c("_n") < 2), "only one member"), ("alternative_group_id", has_group & (c("_postings") > 1), "used in several postings"),
        ("required_or_preferred", has_group & (c("_requirements") > 1), "mixed in an alternative group"), ("skill_statement", has_group & (c("_skills") < c("_stated")), "twice in an alternative group"),
    ]
    return _broken(counted, ["annotation_id"], rules)


def _broken(rows: DataFrame, keys: list[str], rules: list) -> DataFrame:
    """``(keys, field, problem)`` for each ``(field, test, problem)`` that a row meets, with its ``source_row`` if it has one."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(p).alias("problem"))) for f, test, p in rules]))
    kept = [*keys, *[c for c in ("source_row",) if c in rows.columns]]
    return rows.select(*kept, F.explode(found).alias("p")).select(*kept, "p.field", "p.problem")


def review_problems(reviews: DataFrame, selected: DataFrame, skills: DataFrame, snapshot_id: str | None = None) -> DataFrame:
    """``(posting_id, field, problem)`` of the review rows of postings, and of selected postings without one.

    reviews: ``posting_id, split, review_status, annotator_id, reviewed_at`` and, where a snapshot is
    given, ``snapshot_id``. Rules: a selected posting, listed once, of the selection's split and snapshot,
    a known status; a reviewed one has an annotator and an ISO date, one not started no annotations.
    """
    c = F.col
    blank = lambda n: F.coalesce(F.trim(c(n)), F.lit("")) == ""
    has = skills.select("posting_id", F.lit(True).alias("_skills")).distinct()
    chosen = selected.select("posting_id", F.col("split").alias("_split"), F.lit(True).alias("_selected"))
    rows = reviews.withColumn("_times", F.count("*").over(Window.partitionBy("posting_id"))).join(chosen, "posting_id", "left").join(has, "posting_id", "left")
    reviewed = c("review_status") == "reviewed"
    rules = [
        ("posting_id", c("_selected").isNull(), "not selected"), ("posting_id", c("_times") > 1, "listed more than once"), ("split", c("_selected") & ~c("split").eqNullSafe(c("_split")), "another split"),
        ("review_status", ~F.coalesce(c("review_status").isin(*STATUSES), F.lit(False)), "unknown value"), ("annotator_id", reviewed & blank("annotator_id"), "missing on a reviewed posting"),
        ("reviewed_at", reviewed & ~F.coalesce(c("reviewed_at").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date("reviewed_at").isNotNull(), F.lit(False)), "no ISO date"),
        ("posting_id", (c("review_status") == "not_started") & c("_skills"), "annotated but not started"),
    ]
    if snapshot_id:
        rules.append(("snapshot_id", ~c("snapshot_id").eqNullSafe(F.lit(snapshot_id)), "another snapshot"))
    broken = _broken(rows, ["posting_id"], rules)
    missing = selected.select("posting_id").distinct().join(reviews, "posting_id", "left_anti").select("posting_id", F.lit("posting_id").alias("field"), F.lit("selected but missing").alias("problem"))
    return broken.unionByName(missing, allowMissingColumns=True)


def review_progress(reviews: DataFrame, skills: DataFrame) -> DataFrame:
    """One row: postings by status, and reviewed ones with and without annotations."""
    has = skills.groupBy("posting_id").agg(F.count("*").alias("_n"))
    rows = reviews.join(has, "posting_id", "left")
    done = F.col("review_status") == "reviewed"
    return rows.agg(
        F.count("*").alias("selected"), *[F.count_if(F.col("review_status") == s).alias(s) for s in STATUSES],
        F.count_if(done & F.col("_n").isNotNull()).alias("reviewed_with_skills"), F.count_if(done & F.col("_n").isNull()).alias("reviewed_zero_skills"),
    ).withColumn("complete", F.col("reviewed") == F.col("selected"))
