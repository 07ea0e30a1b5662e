"""Text functions as Column expressions, evaluated in the JVM.

Case folding uses ``lower`` here; where full Unicode folding and NFKC are needed, use
``lodestrata.functions.udfs.norm_key``. ``\\w`` is spelt out as letters, marks, digits and the
underscore, since Java's is ASCII-only. Nulls give null unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"
TOKEN = r"[\p{L}\p{N}_]+"


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def hash_key(text: Column) -> Column:
    """What exact duplicates share: folded, collapsed text; null if nothing is left."""
    return F.nullif(collapse(F.lower(text)), F.lit(""))


def text_hash(text: Column) -> Column:
    """SHA-256 of ``hash_key`` in hex; null for empty text."""
    return F.sha2(hash_key(text), 256)


def plain_words(text: Column) -> Column:
    """White-space separated pieces; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda t: t != "")


def word_count(text: Column) -> Column:
    """Pieces that hold a letter or digit; a null text has none."""
    return F.size(F.filter(plain_words(text), lambda t: t.rlike(r"[\p{L}\p{N}]"))).cast("bigint")


def plain_length(text: Column) -> Column:
    return F.size(plain_words(text)).cast("bigint")


def straight_quotes(text: Column) -> Column:
    return F.replace(text, F.lit("’"), F.lit("'"))


def title_key(title: Column) -> Column:
    """Title for grouping: folded and collapsed; a null title is an empty one."""
    return collapse(F.lower(F.coalesce(title, F.lit(""))))


def base_title(title: Column) -> Column:
    """``title_key`` without parenthesised parts at the end, however many."""
    return collapse(F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"(\s*\([^()]*\)\s*)+$", "")))


def token_set(text: Column) -> Column:
    """Distinct word tokens of the folded text; a null text has none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def paragraphs(text: Column) -> Column:
    """Parts between blank lines."""
    return F.split(text, r"\n\s*\n")


def split_labels(text: Column) -> Column:
    """Lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda t: F.trim(t)), lambda t: t != "")


def dropped_labels(text: Column) -> Column:
    """How many lines ``split_labels`` leaves out; none for an empty text."""
    whole = F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(text, "\n")))
    return whole - F.size(split_labels(text))


def split_uris(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n,]+"), lambda t: F.trim(t)), lambda t: t != "")


def occurrences(text: Column, needle: Column) -> Column:
    """Zero-based starts of all occurrences, overlapping ones too; none for a null or an empty needle.

    The first two are searched for; only where there is a second are the places behind it tested
    one by one.
    """
    first = F.position(needle, text, F.lit(1))
    second = F.position(needle, text, first + 1)
    rest = F.filter(F.sequence(second - 1, F.greatest(F.length(text) - F.length(needle), second - 1)), lambda i: F.substring(text, i + 1, F.length(needle)) == needle)
    return (
        F.when(text.isNull() | needle.isNull() | (needle == "") | (first == 0), F.array().cast("array<int>"))
        .when(second == 0, F.array(first - 1))
        .otherwise(F.concat(F.array(first - 1), rest))
    )


#: Why a passage has no place, and how one was found.
NO_PLACE = {
    "empty": "empty evidence_text",
    "absent": "unsupported: evidence_text does not occur in clean_text",
    "several": ("ambiguous: evidence_text occurs ", " times and "),
    "no context": "context not found",
    "contexts": "context occurs more than once",
    "outside": "evidence not inside context",
    "repeated": "evidence repeated inside context",
}
PLACED = {"unique": "unique", "context": ("context (", " occurrences)"), "trimmed": ", trimmed whitespace"}


def resolve_evidence(text: Column, evidence: Column, context: Column) -> Column:
    """``struct(start, end, resolution, reason)`` of an evidence passage in a text.

    The places of the passage are narrowed to those that lie within the context's only place; a
    passage with one place has it, others none, and ``reason`` says why. A passage that occurs once
    needs no context. Blanks around evidence and context don't count; a null is empty.
    """
    wanted, frame = (F.trim(F.coalesce(c, F.lit(""))) for c in (evidence, context))
    places, frames = occurrences(text, wanted), occurrences(text, frame)
    last = F.get(frames, F.lit(0)) + F.length(frame) - F.length(wanted)
    within = F.when(F.size(frames) == 1, F.filter(places, lambda p: p.between(F.get(frames, F.lit(0)), last))).otherwise(F.array().cast("array<int>"))
    chosen = F.when(F.size(places) == 1, places).otherwise(within)
    start = F.when(F.size(chosen) == 1, F.get(chosen, F.lit(0)))
    doubt = F.when(F.size(frames) == 0, NO_PLACE["no context"]).when(F.size(frames) > 1, NO_PLACE["contexts"]).when(F.size(within) == 0, NO_PLACE["outside"]).otherwise(NO_PLACE["repeated"])
    count = F.size(places).cast("string")
    reason = F.when(wanted == "", NO_PLACE["empty"]).when(F.size(places) == 0, NO_PLACE["absent"]).when(start.isNull(), F.concat(F.lit(NO_PLACE["several"][0]), count, F.lit(NO_PLACE["several"][1]), doubt))
    found = F.when(F.size(places) == 1, PLACED["unique"]).otherwise(F.concat(F.lit(PLACED["context"][0]), count, F.lit(PLACED["context"][1])))
    how = F.when(start.isNotNull(), F.concat(found, F.when(wanted.eqNullSafe(evidence) | evidence.isNull(), "").otherwise(PLACED["trimmed"])))
    return F.struct(start.alias("start"), (start + F.length(wanted)).alias("end"), how.alias("resolution"), reason.alias("reason"))


def nth_occurrence(text: Column, needle: Column, n: Column | int) -> Column:
    """Zero-based start of the n-th occurrence, from 1, overlapping ones counted; null if there are fewer."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.get(occurrences(text, needle), n - 1)


#: What tells a place in the United States.
IN_US = r"\bUS\b|United States|, [A-Z]{2}\b|California|Remote - United States"


def outside_us(location: Column) -> Column:
    """Whether a location names no place in the United States; an unknown one names none."""
    return ~F.coalesce(location, F.lit("")).rlike(IN_US)


def several_places(location: Column) -> Column:
    """Whether a location lists more than one place."""
    return F.coalesce(location, F.lit("")).rlike(";|•")


def is_remote(location: Column) -> Column:
    return F.contains(F.lower(F.coalesce(location, F.lit(""))), F.lit("remote"))


def span_holds(text: Column, start: Column, end: Column, evidence: Column) -> Column:
    """Whether text[start:end] is the evidence, with 0 <= start < end <= length; false where anything is null."""
    inside = (start >= 0) & (start < end) & (end <= F.length(text))
    return F.coalesce(inside & (F.substring(text, (start + 1).cast("int"), (end - start).cast("int")) == evidence), F.lit(False))


def around(text: Column, start: Column, end: Column, margin: int = 40) -> Column:
    """The span with ``margin`` characters on either side."""
    first = F.greatest(start - margin, F.lit(0)).cast("int")
    return F.substring(text, first + 1, (end + margin).cast("int") - first)


def shorten(text: Column, most: int) -> Column:
    """The collapsed text, cut to ``most`` characters with an ellipsis."""
    flat = collapse(text)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 1), F.lit("…")))


def safe_name(key: Column) -> Column:
    return F.replace(key, F.lit(":"), F.lit("__"))


def escape_pipes(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def reasons(*flags: tuple[Column, Column | str]) -> Column:
    """The texts of the flags that hold, in order, joined by semicolons; '' for none."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in flags])), ";")


def is_missing(column: Column, kind: str) -> Column:
    """Null, blank, or an empty array."""
    if kind.startswith("array"):
        return column.isNull() | (F.size(column) == 0)
    return column.isNull() | (F.trim(column.cast("string")) == "")


def agrees(declared: Column, found: Column) -> Column:
    """Equality in any case, null where either side is missing; an empty declaration is missing."""
    given = F.nullif(F.lower(declared), F.lit(""))
    return F.when(given.isNotNull() & found.isNotNull(), given == F.lower(found))


def cache_key(**fields: Column) -> Column:
    """SHA-256 over the fields as JSON, in the order of their names; nulls count."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def utc_stamp(moment: Column) -> Column:
    """ISO text with Z of a timestamp in a UTC session."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def snapshot_stamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyyMMdd'T'HHmmss'Z'")


def note_flags(notes: Column) -> Column:
    """Flags that a note's wording sets, in order; none for null."""
    n = F.coalesce(notes, F.lit(""))
    return F.array_compact(F.array(
        F.when(F.contains(n, F.lit("DISCUSS")), "discuss"), F.when(F.contains(n, F.lit("illustrative list")), "illustrative"), F.when(n.startswith("AI-SUGGESTED"), "suggested_addition"),
    ))


def version_in(line: Column) -> Column:
    """The first version like v1.2 in a line, without its v; null if there is none."""
    return F.nullif(F.regexp_extract(line, r"\bv(\d+(?:\.\d+)+)", 1), F.lit(""))


def relabelled(value: Column, labels: dict[str, str], default: str = "unknown") -> Column:
    """Display label of a value."""
    found = F.lit(default)
    for k, v in labels.items():
        found = F.when(value == k, v).otherwise(found)
    return found


def envelope(tag: str, text: Column, **attributes: Column) -> Column:
    """A text between tags with attributes, as prompts carry it; nulls are empty."""
    head = [F.lit(f"<{tag}")]
    for name, column in attributes.items():
        head += [F.lit(f' {name}="'), F.coalesce(column.cast("string"), F.lit("")), F.lit('"')]
    return F.concat(*head, F.lit(">\n"), F.coalesce(text, F.lit("")), F.lit(f"\n</{tag}>"))
