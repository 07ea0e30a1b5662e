"""Queries of the problems with training text, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.llm import bktree, bpe, langmix, leakage, readlevel, residue, setsketch
from lodestrata.operators.snapshots import latest_snapshot, valid_rows

LEAST_WORDS = 40
#: Where the public vocabulary of the encoding query lies.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _latest(spark, folder, columns):
    """Valid rows of the latest snapshot, however short."""
    postings = _table(spark, folder, "postings")
    rows = postings.where(F.col("snapshot_id") == F.lit(latest_snapshot(postings)))
    return valid_rows(rows, ["posting_id"], "fetched_at", columns)


def _current(spark, folder, columns):
    """Valid rows of the latest snapshot with at least 40 words."""
    return _latest(spark, folder, ["word_count", *columns]).where(F.col("word_count") >= LEAST_WORDS)


def _postings_model(spark, folder):
    postings = _table(spark, folder, "postings")
    return langmix.fit(*langmix.sample(postings, "posting_id", "clean_text", langmix.declared_language(F.col("source_language"))))


def p1_languages(spark, folder):
    """The language of every valid posting of all snapshots and of its segments, with its confidence; a text without words, or of no language of the sample, has none."""
    rows = valid_rows(_table(spark, folder, "postings"), ["snapshot_id", "posting_id"], "fetched_at", ["clean_text"])
    return langmix.assign_languages(rows, _postings_model(spark, folder), ["snapshot_id", "posting_id"], "clean_text")


def p1_found(spark, folder):
    # The declared language travels with the id, so that the labels need no join.
    rows = _current(spark, folder, ["clean_text", "source_language"])
    found = langmix.assign_languages(rows, _postings_model(spark, folder), ["posting_id", "source_language"], "clean_text")
    return found.where(
        F.col("lang").isNotNull() & ((F.col("seg") > 0) | langmix.declares_another(F.col("source_language"), F.col("lang")))
    ).select("posting_id", "seg", "lang").distinct()


def _near(rows):
    return setsketch.near_duplicates(rows, "posting_id", "clean_text")


def p3_found(spark, folder):
    return setsketch.all_pairs(*_near(_current(spark, folder, ["clean_text"])), "posting_id")


def p3_pairs(spark, folder):
    """The pairs of ``p3_found``, across boards and titles, with their text_similarity and token_jaccard."""
    rows = _current(spark, folder, ["clean_text"])
    return setsketch.scored_pairs(setsketch.all_pairs(*_near(rows), "posting_id"), rows, "posting_id", "clean_text")


def p3_classes(spark, folder):
    """Every posting of the latest snapshot, however short, with its class, the copies in it and the classes linked to it."""
    return setsketch.link_counts(*_near(_latest(spark, folder, ["clean_text"])), "posting_id")


def _residue(spark, folder):
    """Valid postings with a segment that is residue. Every delivered row is marked where it is read, so that no text is shuffled to find the valid ones."""
    marked = residue.mark_residue(_table(spark, folder, "postings"), ["snapshot_id", "posting_id", "fetched_at"], ["title", "clean_text"])
    return valid_rows(marked, ["snapshot_id", "posting_id"], "fetched_at", ["coverage", "dense", "kinds"]).where(F.col("dense") >= residue.COVER)


def p4_found(spark, folder):
    return _residue(spark, folder).select("snapshot_id", "posting_id")


def p4_coverage(spark, folder):
    """Valid postings with residue: its kinds, its share, and whether the posting is to be excluded for it."""
    return _residue(spark, folder).withColumn("excluded", F.col("coverage") >= 0.5)


def _concept_labels(spark, folder):
    concepts = _table(spark, folder, "esco_concepts")
    valid = (F.col("status") == "released") & (F.col("concept_type") == "KnowledgeSkillCompetence")
    target = F.when(valid, F.col("concept_uri"))
    return concepts.select(F.col("preferred_label").alias("label"), target.alias("target"), F.lit(0).alias("rank")).unionByName(
        concepts.select(F.explode("alt_labels").alias("label"), target.alias("target"), F.lit(1).alias("rank"))
    )


def p6_found(spark, folder):
    mapped = bktree.map_values(_table(spark, folder, "skills"), ["annotation_id"], "skill_statement", _concept_labels(spark, folder))
    return mapped.select("annotation_id", F.col("target").alias("concept_uri")).distinct()


def p7_ids(spark, folder):
    return bpe.encode(_table(spark, folder, "documents"), "text", ["doc_id"], VOCABULARY)


def _leaks(spark, folder, edited=False):
    docs, items = _table(spark, folder, "documents"), _table(spark, folder, "eval_items")
    return leakage.leaks(docs, "doc_id", "text", items, "item_id", "item_text", edited=edited)


def p8_found(spark, folder):
    """Pairs whose alignment scores what a window of equal words does, and then, exactly, has such a run."""
    scored = _leaks(spark, folder).where(F.col("score") >= leakage.MATCH * leakage.WINDOW)
    return scored.where(F.col("longest_run") >= leakage.WINDOW).select("doc_id", "item_id").distinct()


def p8_alignments(spark, folder):
    """Aligned pairs, edited copies among them, whose score is a quarter of the item's own or more, or whose run makes a leak."""
    return _leaks(spark, folder, edited=True).where((F.col("share") >= 0.25) | (F.col("longest_run") >= leakage.WINDOW))


def _levels(spark, folder):
    docs = _table(spark, folder, "documents")
    graded = readlevel.votes(_table(spark, folder, "reading_labels"), "doc_id", "rater_id", "band")
    model = langmix.fit(*langmix.sample(docs, "doc_id", "text", langmix.declared_language(F.col("lang"))))
    return readlevel.reading_levels(docs, "doc_id", "text", readlevel.fit(docs, "doc_id", "text", graded), model)


def p9_found(spark, folder):
    return _levels(spark, folder).where(F.col("band").isNotNull()).select("doc_id", "band").distinct()


def p9_levels(spark, folder):
    """Every document's level on the scale, with its words and those in English sentences."""
    return _levels(spark, folder)


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_languages, p3_found, p3_pairs, p3_classes, p4_found, p4_coverage, p6_found, p7_ids, p8_found, p8_alignments, p9_found, p9_levels)
}

def _plain_words(column: str) -> str:
    """SQL of a text's words without case, accents, ligatures and width."""
    wide = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
    narrow = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
    text = f"translate({column}, '{wide}', '{narrow}')"
    for whole, parts in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        text = f"replace({text}, '{whole}', '{parts}')"
    return f"regexp_extract_all(lower(strip_accents({text})), '[\\p{{L}}\\p{{N}}]+')"


#: The exact definition of near-duplicate pairs: shared distinct word tokens of the case-folded text.
ORACLE = {
    "p3_found": """
WITH latest AS (SELECT posting_id, arg_max(clean_text, fetched_at) AS t, arg_max(word_count, fetched_at) AS w FROM postings
                WHERE snapshot_id = (SELECT max(snapshot_id) FROM postings) AND posting_id IS NOT NULL GROUP BY posting_id),
sets AS (SELECT posting_id AS p, list_distinct(regexp_extract_all(replace(lower(t), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')) AS s FROM latest WHERE w >= 40),
words AS (SELECT p, unnest(s) AS x FROM sets),
shared AS (SELECT a.p AS a, b.p AS b, count(*) AS n FROM words a JOIN words b ON a.x = b.x AND a.p < b.p GROUP BY ALL)
SELECT h.a AS posting_id_a, h.b AS posting_id_b FROM shared h JOIN sets x ON x.p = h.a JOIN sets y ON y.p = h.b
WHERE n >= 0.8 * (len(x.s) + len(y.s) - n)""",
    "p3_classes": """
WITH latest AS (SELECT posting_id, arg_max(coalesce(clean_text, ''), fetched_at) AS t FROM postings
                WHERE snapshot_id = (SELECT max(snapshot_id) FROM postings) AND posting_id IS NOT NULL GROUP BY posting_id),
sets AS (SELECT posting_id AS p, list_sort(list_distinct(regexp_extract_all(replace(lower(t), 'ß', 'ss'), '[\\p{L}\\p{N}_]+'))) AS s FROM latest),
classes AS (SELECT s, min(p) AS c, count(*) AS n FROM sets GROUP BY s),
words AS (SELECT c, unnest(s) AS x, len(s) AS k FROM classes),
shared AS (SELECT a.c AS a, b.c AS b, a.k + b.k - count(*) AS u, count(*) AS n FROM words a JOIN words b ON a.x = b.x AND a.c <> b.c GROUP BY a.c, b.c, a.k, b.k),
linked AS (SELECT a, count(*) AS n FROM shared WHERE n >= 0.8 * u GROUP BY a)
SELECT p AS posting_id, c AS class, CAST(classes.n - 1 AS BIGINT) AS copies, CAST(coalesce(linked.n, 0) AS BIGINT) AS linked_classes
FROM sets JOIN classes USING (s) LEFT JOIN linked ON linked.a = c""",
    "p8_found": rf"""
WITH docs AS (SELECT doc_id, {_plain_words("text")} AS w FROM documents),
items AS (SELECT item_id, {_plain_words("item_text")} AS w FROM eval_items),
wanted AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM items WHERE len(w) >= 12)),
there AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM docs WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM there JOIN wanted USING (g) WHERE doc_id IS NOT NULL AND item_id IS NOT NULL""",
}
