"""Near-duplicate texts by SetSketch registers.

Every text is the set of its distinct word tokens. Each of m registers keeps, over the set, the
least of exponentially distributed values, cut to an integer on an exponentially spaced scale, so
that registers are mergeable (maximum) and two sets agree in a register with about the probability
of their Jaccard similarity. Bands of registers are the keys by which sets meet; pairs that meet
are screened on register parities, then estimated jointly from how many registers are greater,
equal and less in one of them (maximum likelihood, with known set sizes), and verified on the
token sets themselves.

Texts of equal token sets form a class of which one representative is sketched further, so a group
of copies, however large, enters the search as one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.udfs import seq_ratio
from lodestrata.llm.arrow import lists, mix, pieces
from lodestrata.storage import cut, discard

#: Base of the scale and rate of the values; registers lie in 0 .. TOP.
BASE, RATE, TOP = 1.02, 20.0, 65534
BAND, BANDS = 9, 72
REGISTERS = BAND * BANDS
#: Registers that are kept for the estimate, and those whose parities make the screen.
KEPT, PARITIES = 256, 256
#: Standard deviations by which a pair at the threshold may miss the screen, and the estimate.
SCREEN_SLACK, SLACK = 4.0, 5.0
#: Rows of a bucket that one task pairs; larger buckets are split.
BUCKET = 2_000
_WORD = re.compile(r"\w+")
_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def tokens(text: str) -> set[str]:
    """Distinct word tokens of the case-folded text."""
    return {m[0] for m in _WORD.finditer(text.casefold())}


def token_registers(hashes: np.ndarray) -> np.ndarray:
    """Registers (tokens x m, uint16) of single tokens by their 64-bit hashes."""
    out = np.empty((len(hashes), REGISTERS), dtype=np.uint16)
    for a in range(0, len(hashes), 1024):
        x = mix(hashes[a : a + 1024, None] + _SEEDS[None, :])
        u = ((x >> np.uint64(41)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-23)
        level = np.float32(1) - (np.log(-np.log(u)) - np.float32(np.log(RATE))) * np.float32(1 / np.log(BASE))
        out[a : a + 1024] = np.clip(np.floor(level), 0, TOP)
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (sets x m) of sets of token hashes: the greatest register of any token; an empty set has zeros."""
    out = np.zeros((len(sets), REGISTERS), dtype=np.uint16)
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    if len(full):
        distinct, at = np.unique(np.concatenate([sets[i] for i in full]), return_inverse=True)
        single = token_registers(distinct)
        start = 0
        for i in full:
            out[i] = single[at[start : start + sizes[i]]].max(axis=0)
            start += sizes[i]
    return out


def bands(registers: np.ndarray) -> np.ndarray:
    """One 32-bit key for each band of each sketch."""
    parts = registers.reshape(len(registers), BANDS, BAND).astype(np.uint64)
    key = np.zeros(parts.shape[:2], dtype=np.uint64)
    for i in range(BAND):
        key = mix(key * np.uint64(0x100000001B3) + parts[:, :, i] + np.uint64(1))
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def parities(registers: np.ndarray) -> list[np.ndarray]:
    """The last bits of the first registers, 64 to a long."""
    bits = np.packbits((registers[:, :PARITIES] & 1).astype(np.uint8), axis=1)
    words = np.ascontiguousarray(bits).view(np.int64)
    return [words[:, i] for i in range(words.shape[1])]


def _chance(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sketches (pairs x registers) of sets of known sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    best, at = np.full(len(a), -np.inf), np.zeros(len(a))
    for share in np.linspace(0, 1, 401):
        j = top * share
        p, q = _chance(u - v * j), _chance(v - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = sum(
                np.where(n > 0, n * np.log(np.maximum(x, 1e-12)), 0) for n, x in ((more, p), (less, q), (same, 1 - p - q))
            )
        better = value > best
        best, at = np.where(better, value, best), np.where(better, j, at)
    return at


def sketch_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, text, cid, digest, size, s0.., registers, bands)`` of all rows, written to the shared folder.

    ``digest`` is equal for equal token sets; ``cid`` numbers the rows. A null text is an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "t"):
                words = [sorted(tokens(t)) for t in texts]
                digests = ["\n".join(w).encode("utf-8", "surrogatepass") for w in words]
                known: dict[str, int] = {}
                for w in words:
                    for x in w:
                        if x not in known:
                            known[x] = int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                found = sketch([np.array([known[x] for x in w], dtype=np.uint64) for w in words])
                keys = bands(found)
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("k"), pa.array(texts, pa.string()),
                        pa.array([hashlib.blake2b(d, digest_size=16).digest() for d in digests], pa.binary()),
                        pa.array([len(w) for w in words], pa.int32()),
                        *[pa.array(w) for w in parities(found)],
                        pa.array([r.tobytes() for r in found[:, :KEPT]], pa.binary()),
                        lists(keys.reshape(-1), np.full(n, BANDS)),
                    ],
                    names=["k", "t", "digest", "size", *(f"s{i}" for i in range(PARITIES // 64)), "registers", "bands"],
                )

    source = df.select(df[key].cast("string").alias("k"), df[text].cast("string").alias("t")).where(F.col("k").isNotNull())
    signs = ", ".join(f"s{i} bigint" for i in range(PARITIES // 64))
    rows = source.mapInArrow(run, f"k string, t string, digest binary, size int, {signs}, registers binary, bands array<int>")
    return cut(rows.withColumn("cid", F.monotonically_increasing_id()), "sketches")


def _verify(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[str, set[str]] = {}

    def of(text: str) -> set[str]:
        if text not in known:
            if len(known) > 5000:
                known.clear()
            known[text] = tokens(text)
        return known[text]

    out = []
    for x, y in zip(a, b, strict=True):
        p, q = of(x), of(y)
        both = len(p & q)
        out.append(both / (len(p) + len(q) - both) if p or q else 1.0)
    return pd.Series(out, dtype="float64")


def _estimated(a: pd.Series, b: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    x = np.frombuffer(b"".join(a), dtype=np.uint16).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), dtype=np.uint16).reshape(len(b), -1)
    return pd.Series(estimate(x, y, m.to_numpy(float), n.to_numpy(float)))


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Classes and links of rows whose token sets are at least ``threshold`` alike.

    Result: ``members (key, class)`` - every row with the number of its class, rows of equal token
    sets in one class - and ``links (class_a, class_b, estimate, jaccard)``, pairs of different
    classes, class_a < class_b, by the registers and verified on the texts. Together they hold
    every pair: two members of one class, or members of two linked classes.

    A null text is an empty one; all texts without tokens form one class, which is linked to none.
    Rows with a null key are left out; keys are cast to string, and repeated rows count once. Very
    long texts count whole. An empty table gives empty results. Other columns are not read.

    Recall: two sets at the threshold 0.8 meet in one of the 72 bands of 9 registers with
    probability 1 - 3e-5, more alike ones with more; the screen leaves 4 standard deviations, the
    estimate 5. Buckets beyond 2,000 rows are split into blocks that meet each other, so no task
    gets a whole hot bucket, and no bucket is left out.
    """
    rows = sketch_rows(df, key, text)
    classes = rows.groupBy("digest").agg(F.min("cid").alias("class"))
    members = cut(rows.select("k", "digest").join(classes, "digest").select("k", "class").distinct(), "members")
    heads = classes.select(F.col("class").alias("cid"))
    signs = [f"s{i}" for i in range(PARITIES // 64)]
    kept = rows.where(F.col("size") > 0).join(heads, "cid", "left_semi")
    entries = kept.select("cid", "size", *signs, F.posexplode("bands").alias("band", "hash")).select(
        "cid", "size", *signs, (F.col("band").cast("bigint") * F.lit(1 << 32) + F.col("hash").cast("bigint")).alias("key")
    )
    # Blocks of each bucket that has any two rows; a bucket of usual size has one.
    buckets = (
        kept.select(F.posexplode("bands").alias("band", "hash"))
        .select((F.col("band").cast("bigint") * F.lit(1 << 32) + F.col("hash").cast("bigint")).alias("key"))
        .groupBy("key").count().where(F.col("count") > 1)
        .select("key", F.ceil(F.col("count") / BUCKET).cast("int").alias("blocks"))
    )
    placed = entries.join(buckets, "key").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # Block i meets blocks i .. n-1: its rows go to those pairs as the left, and each row to the pairs that end in its block as the right.
    left = placed.select("key", F.col("block").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"), *[F.col(c).alias(f"{c}_a") for c in ("cid", "size", *signs)])
    right = placed.select("key", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("x"), F.col("block").alias("y"), *[F.col(c).alias(f"{c}_b") for c in ("cid", "size", *signs)])
    agree = threshold + (1 - threshold) / 2
    allowed = int(PARITIES * (1 - agree) + SCREEN_SLACK * np.sqrt(PARITIES * agree * (1 - agree))) + 1
    unlike = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in signs), F.lit(0))
    met = (
        left.join(right, ["key", "x", "y"])
        .where((F.col("x") < F.col("y")) | (F.col("cid_a") < F.col("cid_b")))
        .where(F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * threshold)
        .where(unlike <= allowed)
        .select(F.least("cid_a", "cid_b").alias("cid_a"), F.greatest("cid_a", "cid_b").alias("cid_b"))
        .distinct()
    )

    def with_both(pairs: DataFrame, columns: list[str]) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(rows.select(F.col("cid").alias(f"cid_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns]), f"cid_{side}")
        return pairs

    least = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / KEPT)
    guess = F.pandas_udf(_estimated, "double")
    likely = (
        with_both(met, ["registers", "size"])
        .select("cid_a", "cid_b", guess("registers_a", "registers_b", "size_a", "size_b").alias("estimate"))
        .where(F.col("estimate") >= least)
    )
    exact = F.pandas_udf(_verify, "double")
    links = (
        with_both(likely, ["t"])
        .select(F.col("cid_a").alias("class_a"), F.col("cid_b").alias("class_b"), "estimate", exact("t_a", "t_b").alias("jaccard"))
        .where(F.col("jaccard") >= threshold)
    )
    links = cut(links, "links")
    discard(rows)
    return members.withColumnRenamed("k", key), links


def _in_blocks(members: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``(p, class, block, blocks)`` of all members, and ``(class, blocks)`` of the classes beyond ``BUCKET`` rows, which are cut into blocks; there are at most rows / ``BUCKET`` of these."""
    sizes = members.groupBy("class").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("blocks")).where("blocks > 1")
    rows = members.select(F.col(key).alias("p"), "class").join(sizes, "class", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return rows.withColumn("block", F.pmod(F.xxhash64("p"), F.col("blocks")).cast("int")), sizes


def all_pairs(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """``(key_a, key_b)``, smaller first: every pair of different keys that classes and links stand for.

    The blocks of a class meet each other, and those of linked classes, as rows of their own, so that
    no task gets a great class whole.
    """
    rows, sizes = _in_blocks(members, key)
    left = rows.select("class", F.col("block").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"), "p")
    right = rows.select("class", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("x"), F.col("block").alias("y"), F.col("p").alias("q"))
    within = left.join(right, ["class", "x", "y"]).where((F.col("x") < F.col("y")) | (F.col("p") < F.col("q"))).select("p", "q")
    placed = links.select("class_a", "class_b")
    for side, block in (("a", "x"), ("b", "y")):
        placed = placed.join(sizes.select(F.col("class").alias(f"class_{side}"), F.col("blocks").alias(f"blocks_{side}")), f"class_{side}", "left")
        placed = placed.withColumn(block, F.explode(F.sequence(F.lit(0), F.coalesce(f"blocks_{side}", F.lit(1)) - 1)))
    a = rows.select(F.col("class").alias("class_a"), F.col("block").alias("x"), "p")
    b = rows.select(F.col("class").alias("class_b"), F.col("block").alias("y"), F.col("p").alias("q"))
    across = placed.join(a, ["class_a", "x"]).join(b, ["class_b", "y"]).where(F.col("p") != F.col("q")).select("p", "q")
    return (
        within.unionByName(across).select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
        .distinct()
        .select(F.col("p").alias(f"{key}_a"), F.col("q").alias(f"{key}_b"))
    )


def scored_pairs(pairs: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """``pairs (key_a, key_b)`` with ``text_similarity`` (Ratcliff-Obershelp, as in the review list) and ``token_jaccard``.

    Both are rounded to 4 places and computed once for each two different texts, however many pairs
    of rows hold them; equal texts are alike by definition. df: the rows, one for each key.
    """
    rows = df.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.sha2("t", 256))
    digests = cut(rows.select("k", "h"), "digests")
    texts = rows.groupBy("h").agg(F.min("t").alias("t"))
    held = pairs.select(F.col(f"{key}_a").alias("a"), F.col(f"{key}_b").alias("b"))
    for side in "ab":
        held = held.join(digests.select(F.col("k").alias(side), F.col("h").alias(f"h_{side}")), side)
    held = cut(held, "held")
    unlike = held.where("h_a <> h_b").select("h_a", "h_b").distinct()
    for side in "ab":
        unlike = unlike.join(texts.select(F.col("h").alias(f"h_{side}"), F.col("t").alias(f"t_{side}")), f"h_{side}")
    exact = F.pandas_udf(_verify, "double")
    scores = unlike.select("h_a", "h_b", F.round(seq_ratio("t_a", "t_b"), 4).alias("s"), F.round(exact("t_a", "t_b"), 4).alias("j"))
    return held.join(scores, ["h_a", "h_b"], "left").select(
        F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"),
        F.when(F.col("h_a") == F.col("h_b"), 1.0).otherwise(F.col("s")).alias("text_similarity"),
        F.when(F.col("h_a") == F.col("h_b"), 1.0).otherwise(F.col("j")).alias("token_jaccard"),
    )


def link_counts(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """``(key, class, copies, linked_classes)``: each row with its class, named by its least key, the class's other rows and its links."""
    sizes = members.groupBy("class").agg(F.min(key).alias("_name"), (F.count("*") - 1).alias("copies"))
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("linked_classes"))
    return (
        members.join(sizes, "class").join(ends, "class", "left")
        .select(key, F.col("_name").alias("class"), "copies", F.coalesce("linked_classes", F.lit(0).cast("bigint")).alias("linked_classes"))
    )
