"""Near-duplicate documents: MinHash bands, confirmed links, connected components.

1. A sketch of every document: the number of its distinct shingles, a digest of the whole
   set and the minima of many universal hashes over it. Documents with equal sets form a
   class at once; from here on only the smallest id of each class travels.
2. Bands of the minima give buckets. A bucket links each member to its hub, never all
   pairs: the member that shares most buckets with others, in later rounds another one.
   The signatures discard clear misses, the full sets confirm.
3. Components by alternating large-star and small-star. Buckets whose members are of
   several components go into the next round.
4. A link can hide in a bucket that stays unsettled after all rounds. For the members of
   such buckets a prefix join is exact: ordered by rarity, two sets at the threshold share
   one of their first rarest shingles. New pairs are confirmed on the full sets, and the
   components are formed again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, col, in_arrow, rows_in
from .textkit import U64, flat, lower_ascii, mix, slices, span_hashes, words

#: 32 bands of 4 minima miss a pair at similarity 0.8 with odds of 5 in 10 ** 8.
BANDS, ROWS = 32, 4
#: A pair whose share of equal minima is below threshold - SLACK is no match: five standard errors of 128 minima.
SLACK = 0.2
#: Rounds of links to a hub of each bucket, before the exact search for what is left.
ROUNDS = 3
#: 64-bit words of the bits that bound from below how many shingles two sets do not share.
ODD = 8
#: Shingles whose 128 hashes are computed at once.
BLOCK = 1 << 14


@dataclass(frozen=True)
class Likeness:
    """Words of a shingle, and the least intersection over union, in hundredths."""

    shingle: int = 5
    percent: int = 80


def shingle_sets(texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted inside each, and the count of each text.

    A-Z is lower-cased, words are runs without white space. With fewer words than `width`
    the whole sequence is one shingle; a text without words has none.
    """
    data, offsets = flat(texts)
    data = lower_ascii(data)
    starts, ends, owner = words(data, offsets)
    n = len(offsets) - 1
    hashes = span_hashes(data, starts, ends)
    per = np.bincount(owner, minlength=n)
    with np.errstate(over="ignore"):
        made = np.zeros(len(hashes), U64)
        for i in range(width):
            reach = max(0, len(made) - i)
            made[:reach] = made[:reach] * U64(0x9FB21C651E98DF25) + hashes[i:]
        left = np.repeat(np.cumsum(per), per) - np.arange(len(hashes))
        full = left >= width
        short = np.flatnonzero((per > 0) & (per < width))
        firsts = (np.cumsum(per) - per)[short]
        whole = np.zeros(len(short), U64)
        for i in range(width - 1):
            inside = i < per[short]
            whole[inside] = whole[inside] * U64(0x9FB21C651E98DF25) + hashes[firsts[inside] + i]
        values = np.concatenate([mix(made[full] + U64(width)), mix(whole + per[short].astype(U64))])
    keys = np.concatenate([owner[full], short])
    order = np.lexsort((values, keys))
    values, keys = values[order], keys[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (keys[1:] != keys[:-1])
    return values[fresh], np.bincount(keys[fresh], minlength=n)


def multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    draw = lambda: rng.integers(0, 1 << 63, count, dtype=U64) * U64(2) + U64(1)
    return draw(), draw()


def minima(values: np.ndarray, counts: np.ndarray, count: int) -> np.ndarray:
    """The minimum of each of `count` multiply-add-shift hashes over each text's shingles, a row per text."""
    a, b = multipliers(count)
    out = np.full((len(counts), count), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(counts)
    ends = np.cumsum(counts[some])
    start = 0
    with np.errstate(over="ignore"):
        while start < len(some):  # runs of whole texts, of about BLOCK shingles
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
            part, at = values[base : ends[stop - 1]], np.r_[0, ends[start : stop - 1] - base]
            for k in range(count):
                hashed = ((part * a[k] + b[k]) >> U64(32)).astype(np.uint32)
                out[some[start:stop], k] = np.minimum.reduceat(hashed, at)
            start = stop
    return out


def sketches(docs: DataFrame, like: Likeness, bands: int, rows: int) -> DataFrame:
    """doc_id, n, whole (digest of the set), signature (minima as 32-bit little-endian)."""

    def run(batches):
        for batch in batches:
            for ids, texts in slices(batch.column(0), batch.column(1)):
                values, counts = shingle_sets(texts, like.shingle)
                packed, ends = values.tobytes(), np.cumsum(counts) * 8
                signs = minima(values, counts, bands * rows).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(counts, pa.int64()),
                        pa.array([hashlib.blake2b(packed[e - c * 8 : e], digest_size=16).digest() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary()),
                        pa.array([s.tobytes() for s in signs], pa.binary()),
                    ],
                    ["doc_id", "n", "whole", "signature"],
                )

    return in_arrow(docs, run, "doc_id bigint, n bigint, whole binary, signature binary")


def full_sets(docs: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, shingles (array of distinct hashes), odd (for each of 512 bins of hashes, a bit that tells an odd number of them)."""

    def run(batches):
        for batch in batches:
            for ids, texts in slices(batch.column(0), batch.column(1)):
                values, counts = shingle_sets(texts, like.shingle)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values.view(np.int64)))
                odd = np.zeros((len(counts), ODD), U64)
                np.bitwise_xor.at(odd, (np.repeat(np.arange(len(counts)), counts), (values >> U64(6)) % U64(ODD)), U64(1) << (values & U64(63)))
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * ODD), pa.array(odd.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, lists, bits], ["doc_id", "shingles", "odd"])

    return in_arrow(docs, run, "doc_id bigint, shingles array<bigint>, odd array<bigint>")


def alike_signatures(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b, sa, sb) of which at least `least` minima agree, without the signatures."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                good = (left == right).sum(axis=1) >= least
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return in_arrow(pairs, run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b")


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) of all nodes of the links (a, b), root the smallest node reachable, by alternating large-star and small-star."""

    def star(links: DataFrame, large: bool) -> DataFrame:
        near = links.union(links.select("b", "a")) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
        joined = near.join(least, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        rest = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        return rest.union(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()

    def mark(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = scratch.save(edges.where("a <> b").select("a", "b").distinct(), f"{name}-0")
    before, step = None, 0
    while (now := mark(links)) != before:
        before, step = now, step + 1
        links = scratch.save(star(links, large=True), f"{name}-{step}l")
        links = scratch.save(star(links, large=False), f"{name}-{step}")
        scratch.drop(f"{name}-{step}l", f"{name}-{step - 1}")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def hub_pairs(rooted: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Pairs (a, b) of each member and the hub of its bucket, where these have different roots; the least rank makes the hub."""
    # a table of its own, so that the join reads two plain shuffles, of which Spark can split a large bucket
    hubs = scratch.save(rooted.groupBy("bucket").agg(F.min(F.struct("rank", "doc_id", "root")).alias("hub")), name)
    met = rooted.select("bucket", "doc_id", "root").join(hubs, "bucket").where("root <> hub.root")
    return met.select(F.greatest("doc_id", "hub.doc_id").alias("a"), F.least("doc_id", "hub.doc_id").alias("b")).distinct()


def signed(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """The pairs with the signatures of both, sa and sb."""
    for side in "ab":
        pairs = pairs.join(signs.select(F.col("doc_id").alias(side), F.col("signature").alias(f"s{side}")), side)
    return pairs


def rare_pairs(open_docs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of documents of different roots that share a shingle among their rarest: no pair at the threshold is missed.

    Of n shingles by rarity the first n - ceil(n * percent / 100) + 1 are a document's
    prefix; sets at the threshold meet in their prefixes. All they share lies at or after
    the first shingle that they share, so what follows its place in both must suffice. And a
    bin whose counts of shingles are odd in one set and even in the other holds at least one
    that they do not share; at the threshold few enough bins may differ.
    """
    about = open_docs.join(sets.select("doc_id", "odd", F.size("shingles").alias("n")), "doc_id")
    tokens = sets.join(open_docs.select("doc_id"), "doc_id").select("doc_id", F.explode("shingles").alias("token"))
    # tables of their own, so that the joins read plain shuffles, of which Spark can split a large token
    counts = scratch.save(tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"), "often")
    shared = tokens.join(counts, "token").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("sorted"))
    # shingles of one document only come first in the order and meet nothing
    alone, most = F.col("n") - F.size("sorted"), F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = (
        shared.join(about.select("doc_id", "root", "n"), "doc_id")
        .select("doc_id", "root", (F.col("n") - alone).alias("rest"), F.posexplode(F.slice("sorted", F.lit(1), F.greatest(most - alone, F.lit(0)).cast("int"))).alias("place", "at"))
        .select("doc_id", "root", (F.col("rest") - F.col("place")).alias("rest"), F.col("at.token").alias("token"))
    )
    prefix = scratch.save(prefix, "prefix")
    mixed = prefix.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    mixed = scratch.save(mixed, "meeting")
    prefix = scratch.save(prefix.join(mixed, "token").join(about.select("doc_id", "n", "odd"), "doc_id"), "mixed")
    left = prefix.select("token", F.col("doc_id").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("rest").alias("la"), F.col("odd").alias("oa"))
    right = prefix.select("token", F.col("doc_id").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("rest").alias("lb"), F.col("odd").alias("ob"))
    fits = F.least("la", "lb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    apart = sum(F.bit_count(F.col("oa")[i].bitwiseXOR(F.col("ob")[i])) for i in range(ODD))
    fits = fits & (apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
    return left.join(right, "token").where((F.col("ra") < F.col("rb")) & fits).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Likeness = Likeness(), bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    component_id is the smallest id reachable over links, a document itself included. Null
    and empty texts have no shingles and no links. Rows of one id are one document; if
    their texts differ, any of these may speak for it. A row with a null id has a null
    component_id, is kept and has no links.
    Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    texts = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    drawn = scratch.save(sketches(texts, like, bands, rows), "sketches")
    counts, linked = drawn.select("doc_id", "n", "whole"), drawn.where("n > 0 and doc_id is not null")
    classes = scratch.save(linked.groupBy("whole").agg(F.min("doc_id").alias("rep")), "classes")
    chosen = scratch.save(linked.join(classes, ["whole"]).where("doc_id = rep").select("doc_id", "n", "signature"), "chosen")
    width = rows * 4
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * width + 1, F.lit(width))))
    members = chosen.select("doc_id", F.explode(cut).alias("bucket"))
    members = scratch.save(members.join(members.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1"), "bucket"), "members")
    weights = scratch.save(members.groupBy("doc_id").agg(F.sum("held").alias("weight")), "weights")
    sets = scratch.save(full_sets(rows_in(texts, weights, "doc_id", "left_semi"), like).dropDuplicates(["doc_id"]), "sets")
    signs = scratch.save(chosen.join(weights.select("doc_id"), "doc_id").select("doc_id", "signature"), "signs")
    least = int(bands * rows * (like.percent / 100 - SLACK))
    rooted = members.join(weights, "doc_id").select("bucket", "doc_id", F.col("doc_id").alias("root"), F.negative("weight").alias("rank"))
    rooted, roots = scratch.save(rooted, "rooted-0"), weights.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("root"))
    for k in range(1, ROUNDS + 1):
        pairs = scratch.save(alike_signatures(signed(hub_pairs(rooted, scratch, f"hubs-{k}"), signs), least), f"pairs-{k}")
        links = scratch.save(confirmed(pairs, sets, like.percent), f"links-{k}")
        if not links.limit(1).count():
            break
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links), scratch, f"cc-{k}")
        found = rooted.drop("root").join(roots, F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", F.coalesce("root", "doc_id").alias("root"))
        found = scratch.save(found, f"found-{k}")
        unsettled = found.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
        unsettled = scratch.save(unsettled, f"unsettled-{k}")
        rooted = scratch.save(found.join(unsettled, "bucket").withColumn("rank", F.xxhash64("doc_id", F.lit(k))), f"rooted-{k}")
        scratch.drop(f"rooted-{k - 1}", f"pairs-{k}", f"links-{k}", f"hubs-{k}", f"found-{k}", f"unsettled-{k}")
    open_docs = scratch.save(rooted.select("doc_id", "root").distinct(), "open")
    more = scratch.save(confirmed(rare_pairs(open_docs, sets, like.percent, scratch), sets, like.percent), "more")
    scratch.drop("members", "signs", "sets", "prefix", "mixed", "often", "meeting")
    if more.limit(1).count():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), scratch, "again")
    classes = classes.join(roots, F.col("rep") == F.col("node"), "left").select("whole", F.coalesce("root", "rep").alias("component"))
    ruled = counts.join(classes, "whole", "left")
    out = ruled.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Likeness = Likeness()) -> DataFrame:
    """`docs` with one document, that of the smallest id, of each component; all columns stay. Rows of one id stay or go together, rows without an id and texts without words stay."""
    found = near_duplicates(docs, id_col, text_col, like)
    return rows_in(docs, found.where("not kept").select(F.col("doc_id").alias(id_col)), id_col, "left_anti")
