"""Repeated substrings across documents by column-wise sorting of many short strings.

Equal strings of WINDOW bytes share their minimiser, the anchor of ANCHOR bytes with the
least hash in them. Runs of windows with one anchor are pieces; equal windows can only lie
in pieces of one anchor, at the same distance from it.

1. Whole texts that an earlier document holds are removed at once. The others give one row
   per piece: anchor hash, content hash, place. Anchors that occur once end here.
2. Of pieces with equal content (two hashes of 64 bits, and both lengths) all but the first
   are repeats; one row per content goes on, so a piece that a third of all rows hold is
   one string from here on.
3. Pieces with one anchor and different contents are aligned at it. From the last column to
   the first, every piece inserts one symbol per round: the transform of the last round
   holds the symbols, the order of the suffixes that begin in this column follows from the
   last order by a stable sort of them, and so do their common prefixes. A round reads the
   order, the transform and the common prefixes of the one before from a sequential file
   and writes its own to another; windows whose common prefix reaches WINDOW are equal,
   byte by byte, and all but the first of them are repeats.
4. An anchor with more than GROUP contents is split by depth: its pieces are cut into
   blocks of fewer windows, and the bytes that all windows of a block share become the key.
   Blocks go through the same rounds; at the last level a block is one window, its key is
   the window itself, and nothing is left to sort.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, col, in_arrow, rows_in
from .textkit import SLICE_BYTES, U64, flat, mix, powers, slices

WINDOW, ANCHOR = 100, 32
#: Strings of one key that a task sorts together; keys with more are split by depth.
GROUP = 2_000
#: Windows of a block at the levels below the anchor; the last one has to be 1.
BLOCKS = (8, 1)
#: Pieces sorted in one go.
BATCH = 20_000
PLACE_BITS = 28
#: The id that stands for none: the last of all.
LAST = (1 << 63) - 1

def minimisers(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of all texts: anchor hash, content hash, first byte, number of windows, anchor place."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none.astype(U64), none.astype(U64), none, none, none
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=sums[1:])
        inverse = powers(len(data) + 1, inverse=True)
        hashes = mix((sums[anchor:] - sums[:-anchor]) * inverse[: len(data) - anchor + 1])
        low = U64((1 << PLACE_BITS) - 1)
        ranked = (hashes & ~low) | np.arange(len(hashes)).astype(U64)
        reach, width = ranked, 1
        span = window - anchor + 1
        while width * 2 <= span:
            reach = np.minimum(reach[:-width], reach[width:])
            width *= 2
        if width < span:
            reach = np.minimum(reach[: len(reach) - (span - width)], reach[span - width :])
        place = (reach & low).astype(np.int64)  # of the anchor of each window
        sizes = np.diff(offsets)
        inside = np.zeros(len(place) + 1, np.int64)
        long = sizes >= window
        np.add.at(inside, offsets[:-1][long], 1)
        np.add.at(inside, (offsets[1:] - window + 1)[long], -1)
        inside = np.cumsum(inside)[:-1] > 0
        at = np.flatnonzero(inside)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (place[at][1:] != place[at][:-1]) | (np.diff(at) > 1)
        first = at[fresh]
        count = np.diff(np.r_[np.flatnonzero(fresh), len(at)])
        end = first + count + window - 1
        content = mix((sums[end] - sums[first]) * inverse[first] + mix((place[first] - first).astype(U64) * U64(512) + count.astype(U64)))
    return hashes[place[first]], content, first, count, place[first] - first


def pieces(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc_id, part, start, n (windows), lead (bytes before the anchor), anchor, content. A text is read in runs of bounded size."""

    def run(batches):
        for batch in batches:
            keys = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["doc_id", "part"])
            for ids, texts in slices(keys, batch.column(2)):
                data, offsets = flat(texts)
                # only a slice of one text can be longer; its windows are taken run by run
                cuts = range(0, max(1, len(data) - window + 1), SLICE_BYTES) if len(texts) == 1 else [0]
                for at in cuts:
                    last = len(data) if len(texts) > 1 else min(len(data), at + SLICE_BYTES + window - 1)
                    part, bounds = data[at:last], offsets if len(texts) > 1 else np.array([0, last - at])
                    key, content, first, count, lead = minimisers(part, bounds, window, anchor)
                    owner = np.searchsorted(bounds, first, "right") - 1
                    doc, row = (ids.field(k).take(pa.array(owner)) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays(
                        [doc, row, pa.array((first - bounds[owner] + at).astype(np.int64)), pa.array(count.astype(np.int16)), pa.array(lead.astype(np.int16)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64))],
                        ["doc_id", "part", "start", "n", "lead", "anchor", "content"],
                    )

    return in_arrow(docs.select("doc_id", "part", "text"), run, "doc_id bigint, part bigint, start bigint, n smallint, lead smallint, anchor bigint, content bigint")


def column_rounds(rows: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sort the suffixes of aligned strings column by column, from the last to the first: (column, order, common prefix with the one before).

    `rows` holds a string per row, -1 beyond its ends. A round's file has the number of
    strings that have begun, their order, the symbols before them in this order (the
    transform's column), and the common prefixes. Strings are compared inside their group
    alone.
    """
    present = rows >= 0
    with tempfile.TemporaryFile() as one, tempfile.TemporaryFile() as other:
        write_round(one, np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(0, np.int32))
        for c in range(rows.shape[1] - 1, -1, -1):
            order, symbols, prefix = read_round(one)
            # without a symbol before it, a string is through
            stays = symbols >= 0
            if not stays.all():
                order, prefix = kept_order(order, prefix, stays)
                symbols = symbols[stays]
            # a string ends for good when its symbols do: a suffix of no bytes enters before its last column
            entering = np.flatnonzero(present[:, c] & ~(present[:, c + 1] if c + 1 < rows.shape[1] else False))
            if len(entering):
                # with no bytes in common, newcomers stand before the others of their group
                merged = np.r_[entering, order]
                seat = np.argsort(group[merged], kind="stable")
                prefix = np.r_[np.zeros(len(entering), np.int32), prefix][seat]
                fresh = seat < len(entering)
                prefix[1:][fresh[:-1]] = 0
                prefix[np.r_[True, group[merged[seat]][1:] != group[merged[seat]][:-1]]] = 0
                order, symbols = merged[seat], np.r_[rows[entering, c], symbols][seat]
            key = group[order] * 256 + symbols
            seat = np.argsort(key, kind="stable")
            same = np.r_[False, key[seat][1:] == key[seat][:-1]]
            least = np.zeros(len(order), np.int32)
            if same.any():
                here, before = seat[same], seat[np.flatnonzero(same) - 1]
                bounds = np.stack([before + 1, here + 1], 1).ravel()
                least[same] = np.minimum.reduceat(np.r_[prefix, 0], bounds)[::2] + 1
            order, prefix = order[seat], least
            write_round(other, order, rows[order, c - 1] if c else np.full(len(order), -1, np.int16), prefix)
            one, other = other, one
            yield c, order, prefix


def write_round(file, order: np.ndarray, transform: np.ndarray, prefix: np.ndarray) -> None:
    file.seek(0)
    for part, kind in ((np.array([len(order)]), np.int64), (order, np.int32), (transform, np.int16), (prefix, np.int16)):
        part.astype(kind).tofile(file)
    file.flush()


def read_round(file) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    file.seek(0)
    n = int(np.fromfile(file, np.int64, 1)[0])
    order, transform, prefix = (np.fromfile(file, kind, n) for kind in (np.int32, np.int16, np.int16))
    return order.astype(np.int64), transform, prefix.astype(np.int32)


def kept_order(order: np.ndarray, prefix: np.ndarray, stays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leave out strings that have no symbol in this column; what follows one shares with the one before it the least of both."""
    at = np.flatnonzero(stays)
    if not len(at):
        return order[at], prefix[at]
    begin = np.r_[0, at[:-1] + 1]
    least = np.minimum.reduceat(np.r_[prefix, 0], np.stack([begin, at + 1], 1).ravel())[::2]
    return order[at], least.astype(np.int32)


def repeated_windows(texts: list[bytes], group: np.ndarray, lead: np.ndarray, doc: np.ndarray, row: np.ndarray, place: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(string, offset) of the windows of aligned strings that an earlier document, or the same row at an earlier place, holds too.

    `doc` and `row` number the documents in order and the rows, `place` is that of the
    anchor in its row.
    """
    size = np.array([len(t) for t in texts])
    shift = lead.max() - lead
    rows = np.full((len(texts), int((shift + size).max())), -1, np.int16)
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), size)
    rows[owner, np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size) + shift[owner]] = data
    several = len(np.unique(row)) < len(row)
    for c, order, prefix in column_rounds(rows, group):
        long = prefix >= window
        if long.any():
            run = np.cumsum(~long)
            first = np.full(run[-1] + 1, len(doc))
            np.minimum.at(first, run, doc[order])
            late = doc[order] > first[run]
            if several:
                by = np.lexsort((place[order], row[order], run))
                again = (run[by][1:] == run[by][:-1]) & (row[order][by][1:] == row[order][by][:-1])
                late[by[1:][again]] = True
            yield order[late], c - shift[order[late]]


def firsts_and_repeats(rows: DataFrame, keys: list[str], twins: bool, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Of `rows` (keys, doc_id, part, start, ...): (keys and place of the first of each key, the rows that are later than it).

    With `twins`, rows of one id may hold different texts; none of them is earlier than
    another, so the first of each goes on.
    """
    firsts = scratch.save(rows.groupBy(*keys).agg(F.min(F.struct("doc_id", "part", "start")).alias("first")), name)
    joined = rows.join(firsts, keys)
    late = joined.where("first.doc_id < doc_id or first.doc_id = doc_id and first.part = part and first.start < start").drop("first")
    lead = firsts.select(*keys, "first.doc_id", "first.part", "first.start")
    if not twins:
        return lead, late
    others = joined.where("first.doc_id = doc_id and first.part <> part").drop("first")
    own = scratch.save(others.groupBy(*keys, "doc_id", "part").agg(F.min("start").alias("own")), f"{name}-twins")
    late = late.union(others.join(own, [*keys, "doc_id", "part"]).where("start > own").select(*late.columns))
    return lead.union(own.select(*keys, "doc_id", "part", F.col("own").alias("start"))), late


def blocks(strings: DataFrame, block: int, window: int, span: int) -> DataFrame:
    """Strings (key, doc_id, part, start, n, lead, piece) cut into blocks of `block` windows at the same distance from the anchor, under the bytes that all windows of the block share."""
    low = F.col("lead") - (span - 1) + F.col("j") * block
    of = F.sequence(F.floor((span - 1 - F.col("lead")) / block), F.floor((F.col("n") - 1 - F.col("lead") + span - 1) / block))
    cut = strings.select("*", F.explode(of).alias("j")).withColumn("low", low)
    cut = cut.withColumn("a", F.greatest("low", F.lit(0))).withColumn("m", F.least(F.col("low") + block, F.col("n")) - F.col("a"))
    shared = F.substring("piece", (F.col("low") + block).cast("int"), F.lit(window - block + 1))
    return cut.select(
        F.xxhash64("key", "j", shared).alias("key"), "doc_id", "part", (F.col("start") + F.col("a")).alias("start"), F.col("m").cast("smallint").alias("n"), (F.col("lead") - F.col("a")).cast("smallint").alias("lead"),
        F.substring("piece", (F.col("a") + 1).cast("int"), (F.col("m") + window - 1).cast("int")).alias("piece"),
    )


def sorted_strings(strings: DataFrame, window: int, group: int, spark) -> DataFrame:
    """doc_id, part, start, length of the windows of strings (key, doc_id, part, start, lead, piece) that are repeats; no key has more than `group` strings."""

    def sort(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Strings by key; a key's run may go on in the next batch."""
        rest = None
        for part in rows:
            rest = part if rest is None else pd.concat([rest, part], ignore_index=True)
            while len(rest) >= BATCH + group:
                cut = BATCH  # before the key that stands at BATCH
                last = rest.key.to_numpy()
                while cut and last[cut] == last[cut - 1]:
                    cut -= 1
                yield from sorted_part(rest.iloc[:cut])
                rest = rest.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield from sorted_part(rest)

    def sorted_part(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(part):
            return
        doc, row, start, lead = (part[k].to_numpy() for k in ("doc_id", "part", "start", "lead"))
        names, docs = (np.unique(x, return_inverse=True)[1] for x in (part.key.to_numpy(), doc))
        parts = np.unique(np.stack([doc, row], 1), axis=0, return_inverse=True)[1].ravel()
        for at, offset in repeated_windows([bytes(b) for b in part.piece], names, lead.astype(np.int64), docs, parts, start + lead, window):
            yield pd.DataFrame({"doc_id": doc[at], "part": row[at], "start": start[at] + offset, "length": np.full(len(at), window)})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = strings.select("key", "doc_id", "part", "start", "lead", "piece").repartition(n, "key").sortWithinPartitions("key")
    return in_arrow(dealt, sort, "doc_id bigint, part bigint, start bigint, length bigint", "mapInPandas")


def removals(docs: DataFrame, scratch: Scratch, window: int, anchor: int, group: int, twins: bool) -> DataFrame:
    """doc_id, part, start, length: stretches of bytes that earlier strings of `window` bytes cover. `docs` (doc_id, part, text) has each text of an id once."""
    spots = pieces(docs, window, anchor)
    # tables of their own, so that the joins read plain shuffles, of which Spark can split a large key
    often = scratch.save(spots.groupBy("anchor").agg(F.count("*").alias("uses")).where("uses > 1").select("anchor"), "often")
    spots = scratch.save(spots.join(often, "anchor"), "spots")
    firsts, copies = firsts_and_repeats(spots, ["anchor", "content", "n", "lead"], twins, scratch, "firsts")
    found = [copies.select("doc_id", "part", "start", (F.col("n") + (window - 1)).cast("bigint").alias("length"))]
    kinds = scratch.save(firsts.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    open_ = firsts.join(kinds, "anchor").select(F.col("anchor").alias("key"), "n", "lead", "doc_id", "part", "start")
    wanted = scratch.save(open_.groupBy("doc_id", "part").agg(F.collect_list(F.struct("key", "n", "lead", "start")).alias("spots")), "wanted")
    own = ["doc_id", "part"]
    texts = rows_in(docs, wanted, own, "left_semi").join(wanted, own).select(*own, F.col("text").cast("binary").alias("body"), F.explode("spots").alias("s"))
    strings = scratch.save(texts.select("s.key", *own, "s.start", "s.n", "s.lead", F.substring("body", (F.col("s.start") + 1).cast("int"), (F.col("s.n") + (window - 1)).cast("int")).alias("piece")), "strings")
    scratch.drop("wanted")
    for level, block in enumerate((None, *BLOCKS)):
        if block == 1:
            # a string is a window now, and its bytes are the key
            _, late = firsts_and_repeats(strings.select("piece", *own, "start"), ["piece"], twins, scratch, "windows")
            found.append(late.select(*own, "start", F.lit(window).cast("bigint").alias("length")))
            break
        sizes = scratch.save(strings.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), f"sizes-{level}")
        counted = strings.join(sizes, "key")
        found.append(sorted_strings(counted.where(F.col("kinds") <= group), window, group, scratch.spark))
        large = sizes.where(F.col("kinds") > group)
        if not large.limit(1).count():
            break
        strings = scratch.save(blocks(strings.join(large.select("key"), "key"), BLOCKS[level], window, window - anchor + 1), f"strings-{level}")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_sha256.

    A byte goes if a string of `window` bytes that also starts earlier covers it: in a
    document of a smaller id, or in the same row. Null text is empty, texts shorter than
    `window` stay whole. A null id counts as the largest. Of rows with one id, or none, each
    is a document, and none of them is earlier than another; equal ones are cut alike. Extra
    columns are ignored; no rows, no result.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    rows = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    slim = scratch.save(rows.select("doc_id", F.octet_length("text").alias("size"), digest.alias("digest")), "slim")
    repeated = slim.groupBy("doc_id").agg(F.count("*").alias("n"), (F.min("digest") < F.max("digest")).alias("differ")).where("n > 1")
    repeated = scratch.save(repeated.select("doc_id", "differ"), "repeated")
    twins = repeated.where("differ").limit(1).count() > 0
    own = ["doc_id", "part"]
    once = rows.withColumn("part", F.lit(0).cast("long"))
    several = None
    if repeated.limit(1).count():
        # rows of one id are told apart by their text
        several = rows_in(rows, repeated, "doc_id", "left_semi").withColumn("part", F.xxhash64(digest))
        once = rows_in(once, repeated, "doc_id", "left_anti")
        slim = slim.join(repeated, "doc_id", "left").withColumn("part", F.when(F.col("differ").isNotNull(), F.xxhash64("digest")).otherwise(0).cast("long"))
    else:
        slim = slim.withColumn("part", F.lit(0).cast("long"))
    owners = scratch.save(slim.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count("*").alias("copies")).where("copies > 1").select("digest", "owner"), "owners")
    whole = scratch.save(slim.join(owners, "digest").where((F.col("size") >= window) & (F.col("doc_id") > F.col("owner"))).select(*own, "size").distinct(), "whole")
    texts = once if several is None else once.union(several.dropDuplicates(own))
    alone = rows_in(texts.where(F.octet_length("text") >= window), whole, own, "left_anti")
    cuts = removals(alone, scratch, window, anchor, group, twins)
    cuts = cuts.union(whole.select(*own, F.lit(0).cast("bigint"), F.col("size").cast("bigint"))).groupBy(*own)
    cuts = scratch.save(cuts.agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("cuts")), "cuts")
    scratch.drop("spots", "firsts", "strings", "often", "kinds", *(f"strings-{k}" for k in range(len(BLOCKS))))
    rows = once if several is None else once.union(several)

    def cut(batches):
        for batch in batches:
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                body = text.as_buffer()
                size = 0 if body is None else body.size
                keep, runs = None, 0
                if spans.is_valid and size:
                    flags = np.zeros(size + 1, np.int32)
                    start, length = (spans.values.field(k).to_numpy() for k in (0, 1))
                    np.add.at(flags, np.minimum(start, size), 1)
                    np.add.at(flags, np.minimum(start + length, size), -1)
                    gone = np.cumsum(flags)[:-1] > 0
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    keep = np.frombuffer(body, np.uint8)[~gone].tobytes()
                else:
                    keep = b"" if body is None else body.to_pybytes()
                for k, v in zip(out, (size, size - len(keep), runs, keep), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    untouched = rows_in(rows, cuts, own, "left_anti")
    touched = rows_in(rows, cuts, own, "left_semi").join(cuts, own).select("doc_id", "text", "cuts")
    done = in_arrow(touched, cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    plain = untouched.select("doc_id", F.octet_length("text").cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.col("text").cast("binary"))
    named = F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id")
    return done.union(plain).select(named, "n_bytes", "n_removed", "n_spans", "kept", F.sha2("kept", 256).alias("kept_sha256"))
