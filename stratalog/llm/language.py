"""Language of texts: scripts narrow the candidates, per-word scores, and Viterbi with a switching penalty.

A word's score in a language is the sum of the log shares of its byte n-grams, with a blank
at both ends. The path through a text's words that is best after a penalty for each change
of language gives spans; the language with most bytes in its spans is the text's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from .scratch import col, in_arrow
from .textkit import SLICE_BYTES, U64, mix, slices, text_of, words

UNKNOWN = "und"
#: Hashed n-grams; with them the model has BUCKETS numbers for each language.
BUCKETS = 1 << 16
SIZES = (2, 3, 4)
#: About so many labelled rows of each language, drawn by a hash of the id, fit the model.
SAMPLE_ROWS = 3_000
#: Nats that a change of language costs.
SWITCH = 12.0
#: Texts of so many words go through Viterbi together.
TOGETHER = 1 << 19
SMOOTH = 0.5
#: A script is a candidate for a language that has at least this share of its words in it.
LEAST_SHARE = 0.005
LETTER = re.compile(r"[^\W\d_]")
#: First code points of script ranges (Unicode blocks), and the script of each.
RANGES = np.array([0x0, 0x41, 0x5B, 0x61, 0x7B, 0xAA, 0xD7, 0xD8, 0x2B0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0x980, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0])
SCRIPTS = np.array([0, 1, 0, 1, 0, 1, 0, 1, 0, 2, 3, 4, 5, 6, 7, 8, 9, 0, 10, 11, 1, 2, 0, 12, 0, 13, 0, 11, 0])


@dataclass
class Model:
    names: list[str]
    scores: np.ndarray  # BUCKETS x languages, log shares
    scripts: np.ndarray  # scripts x languages, candidates


def padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with a blank before and after each text, and offsets."""
    parts = [f" {t.lower()} ".encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    data = np.where((data >= 9) & (data <= 13), np.uint8(32), data)
    return data, np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)


def scripts_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The script of each word's first letter, 0 without one."""
    lead = np.r_[data, np.zeros(3, np.uint8)].astype(np.int32)
    two, three = (lead[:-3] >= 0xC2) & (lead[:-3] < 0xE0), (lead[:-3] >= 0xE0) & (lead[:-3] < 0xF0)
    point = np.where(two, (lead[:-3] & 31) << 6 | (lead[1:-2] & 63), np.where(three, (lead[:-3] & 15) << 12 | (lead[1:-2] & 63) << 6 | (lead[2:-1] & 63), np.where(lead[:-3] < 0x80, lead[:-3], 0)))
    script = SCRIPTS[np.searchsorted(RANGES, point, "right") - 1]
    at = np.flatnonzero(script)
    if not len(at):
        return np.zeros(len(starts), np.int64)
    next_ = np.minimum(np.searchsorted(at, starts), len(at) - 1)
    return np.where((at[next_] >= starts) & (at[next_] < ends), script[at[next_]], 0)


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """For each size: bucket of the n-gram at each byte, and whether it lies inside a word and its blanks. Each word owns the bytes from the blank before it to its last."""
    owner_end = np.zeros(len(data), np.int64)
    owner_end[starts - 1] = ends + 1
    np.maximum.accumulate(owner_end, out=owner_end)
    packed = np.zeros(len(data), U64)
    long = np.r_[data, np.zeros(max(SIZES), np.uint8)].astype(U64)
    at = np.arange(len(data))
    done = 0
    for size in SIZES:
        for k in range(done, size):
            packed = packed << U64(8) | long[k : k + len(data)]
        done = size
        with np.errstate(over="ignore"):
            hashed = (mix(packed * U64(8) + U64(size)) & U64(BUCKETS - 1)).astype(np.int64)
        yield hashed, at + size <= owner_end


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the text and language of rows for which `usable` (over doc_id) holds; rows without language, text or id do not count."""
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null and doc_id is not null").where(usable)
    counts = rows.groupBy("lang").count().collect()  # a row per language
    names = sorted(r["lang"] for r in counts)
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((SCRIPTS.max() + 1, 0), bool))
    limits = {r["lang"]: min(1.0, SAMPLE_ROWS / r["count"]) for r in counts}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    share = F.element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), F.col("lang"))
    place = {n: k for k, n in enumerate(names)}

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for langs, texts in slices(batch.column(1), batch.column(0)):
                for lang, text in zip(langs.to_pylist(), text_of(texts), strict=True):
                    data, offsets = padded([text])
                    starts, ends, _ = words(data, offsets)
                    if len(starts):
                        own = total.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS) + 1))
                        for bucket, good in grams(data, starts, ends):
                            own[:BUCKETS] += np.bincount(bucket[good], minlength=BUCKETS)
                        own[BUCKETS:] += np.bincount(scripts_of(data, starts, ends), minlength=len(SCRIPTS) + 1)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), place[lang])), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"])

    sums = in_arrow(rows.where(draw < share).select("text", "lang"), run, "lang bigint, bucket bigint, n double")
    sums = sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows a language
    table = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(names)))
    table[sums.bucket.to_numpy(), sums.lang.to_numpy()] = sums.n
    seen, scripts = table[:BUCKETS] + SMOOTH, table[BUCKETS : BUCKETS + SCRIPTS.max() + 1]
    scripts[0] = 0
    return Model(names, np.log(seen / seen.sum(axis=0)).astype(np.float32), scripts >= LEAST_SHARE * np.maximum(1, scripts.sum(axis=0)))


def word_scores(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores (words x languages) and which words have a known script; other words score 0 everywhere."""
    sums = np.zeros((len(starts), len(model.names)), np.float32)
    for bucket, good in grams(data, starts, ends):
        got = model.scores[bucket]
        got[~good] = 0
        sums += np.add.reduceat(got, starts - 1, axis=0)
    open_ = model.scripts[scripts_of(data, starts, ends)]
    known = open_.any(axis=1)
    sums[~open_] = -1e6
    sums[~known] = 0
    return sums, known


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best language of each word. Texts, one after the other in `scores`, advance together, longest first."""
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    live = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")  # texts longer than the step
    states = scores.shape[1]
    back = np.zeros(scores.shape, np.int8 if states < 128 else np.int16)
    own = np.arange(states)
    best = np.zeros((len(sizes), states), np.float64)
    for step, n in enumerate(live.tolist()):
        at = first[:n] + step
        if step:
            now = best[:n]
            top = now.argmax(axis=1)
            change = now[np.arange(n), top] - penalty
            stay = now >= change[:, None]
            back[at] = np.where(stay, own, top[:, None])
            best[:n] = np.where(stay, now, change[:, None]) + scores[at]
        else:
            best[:n] = scores[at]
    path = np.zeros(len(scores), np.int64)
    state = best.argmax(axis=1)
    for step in range(len(live) - 1, -1, -1):
        at = first[: live[step]] + step
        path[at] = state[: live[step]]
        state[: live[step]] = back[at, state[: live[step]]]
    return path


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, whole: bool = False) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score and, with spans, spans (array of first word, word after the last, language).

    With `whole`, doc (a struct of all columns of the row) stands in place of doc_id.

    score is the share of the letter-bearing bytes that lie in spans of lang_pred. Null
    texts and texts without a letter are `und` with score 0 and no spans; a text whose
    scripts were never learned gets the first language by name with score 0. Ties go to
    the first name. Without any learned language all rows are `und`.
    """
    # plain arrays: a class of this package would have to be importable on the executors
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.scores, model.scripts))
    names = [*model.names, UNKNOWN]
    columns = ["doc" if whole else "doc_id", "lang_pred", "score"] + ["spans"] * spans

    def finish(ids, flags, parts):
        """Rows of the texts gathered so far."""
        sizes = np.concatenate([p[0] for p in parts])
        scores, known, weight = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        path, owner = viterbi(scores, sizes), np.repeat(np.arange(len(sizes)), sizes)
        n = len(model.names)
        votes = np.bincount(owner * n + path, weights=np.where(known, weight, 0), minlength=len(sizes) * n).reshape(-1, n)
        top, flags = votes.argmax(axis=1), np.array(flags)
        score = np.where(flags, votes.max(axis=1) / np.maximum(votes.sum(axis=1), 1), 0.0)
        arrays = [pa.concat_arrays(ids), pa.array([names[k] for k in np.where(flags, top, n)]), pa.array(score)]
        if spans:
            found = []
            for end, size, flag in zip(np.cumsum(sizes).tolist(), sizes.tolist(), flags.tolist(), strict=True):
                p = path[end - size : end]
                cut = np.flatnonzero(np.r_[True, p[1:] != p[:-1], True]) if flag and size else np.zeros(0, int)
                found.append([{"start": int(a), "end": int(b), "lang": names[p[a]]} for a, b in zip(cut[:-1], cut[1:], strict=True)])
            arrays.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
        return pa.RecordBatch.from_arrays(arrays, columns)

    def run(batches):
        m = Model(*shared.value)
        ids, flags, parts, held = [], [], [], 0
        for batch in batches:
            first = batch.column(0)
            for key, texts in slices(first, first.field(text_col).cast(pa.string()) if whole else batch.column(1), SLICE_BYTES):
                texts = text_of(texts)
                ids.append(key)
                flags += [bool(m.names) and LETTER.search(t) is not None for t in texts]
                data, offsets = padded(texts)
                starts, ends, owner = words(data, offsets)
                sizes = np.bincount(owner, minlength=len(texts))
                scores, known = word_scores(m, data, starts, ends) if len(starts) else (np.zeros((0, len(m.names)), np.float32), np.zeros(0, bool))
                parts.append((sizes, scores, known, ends - starts))
                held += len(starts)
                if held > TOGETHER:
                    yield finish(ids, flags, parts)
                    ids, flags, parts, held = [], [], [], 0
        if ids:
            yield finish(ids, flags, parts)

    first = F.struct(*(col(c) for c in docs.columns)).alias("doc") if whole else col(id_col).cast("long").alias("doc_id")
    rows = docs.select(first, *([] if whole else [col(text_col).cast("string").alias("text")]))
    found = "array<struct<start: bigint, end: bigint, lang: string>>"
    kinds = StructType([rows.schema[0]]).add("lang_pred", "string").add("score", "double")
    if not model.names:
        return rows.select(columns[0], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), *([F.array().cast(found).alias("spans")] * spans))
    return in_arrow(rows, run, kinds.add("spans", DataType.fromDDL(found)) if spans else kinds)


def drop_unidentified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0) -> DataFrame:
    """`docs` without the rows whose language is unknown or has a score of `least` or less; all columns stay.

    Null and empty texts, texts without a letter and those in no learned script go. A text
    of several languages stays, however its words are shared among them. Ties and repeated
    rows are judged by their text alone; columns keep their names, whatever they are.
    """
    found = identified(docs, model, id_col, text_col, whole=True).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > least))
    return found.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
