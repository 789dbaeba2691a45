"""The whole pipeline against a brute-force version, and stages on odd tables."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratalog.llm import language, mixing
from stratalog.llm.queries_text import remainder, tokenizer_path

from .test_dedup import near_brute
from .test_learned import WORDS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(seed=3):
    rng, rows = random.Random(seed), []
    for i in range(160):
        lang = list(WORDS)[i % 3]
        base = [rng.choice(WORDS[lang].split()) + (str(rng.randrange(9)) if rng.random() < 0.3 else "") for _ in range(rng.randrange(20, 60))]
        rows.append((len(rows), " ".join(base), lang, f"s{i % 5}" if i % 5 else None))
        if i % 6 == 0:  # exact copies, apart from white space
            rows.append((len(rows), "  ".join(base), lang, "s1"))
        if i % 8 == 0:  # a near copy: one word more
            rows.append((len(rows), " ".join([*base, "end"]), lang, "s2"))
    rows += [(9000, None, "aa", "s1"), (9001, "", "bb", "s1"), (9002, "12 34", "aa", None), (9003, "中文", "aa", "s2")]
    rng.shuffle(rows)
    return rows


def mixed_by_hand(rows):
    """Whole copies of (id, text, source) of which no less than half lies before the time at which all sources have given the budget."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    names = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total = {s: sum(size[i] for i, _, t in rows if t == s) for s in names}
    budget, low, high = sum(total.values()), 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(min(mid * weight[s], 3 * total[s]) for s in names) >= budget else (mid, high)
    out = Counter()
    for s in names:
        at = 0
        for i, *_ in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.sha256(str(r[0]).encode()).hexdigest()):
            for e in range(3):
                cut = int(high * weight[s] + 1e-6)
                out[i] += size[i] > 0 and 2 * (cut - at - e * total[s]) >= size[i]
            at += size[i]
    return +out


def test_pipeline_equals_brute_force(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    rows = documents()
    frame = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    known = {r.doc_id for r in language.identified(frame, language.train(frame, remainder(4) != 2)).where("lang_pred <> 'und' and score > 0").collect()}
    assert known == {i for i, *_ in rows if i < 9000}
    first = {}
    for i, t, _, s in sorted(r for r in rows if r[0] in known):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t, s))
    alone = {i for i, _, _, kept in near_brute([(i, t) for i, t, _ in first.values()], 5, 80) if kept}
    left = [(i, t, s) for i, t, s in first.values() if i in alone]
    coder = tokenizers.Tokenizer.from_file(tokenizer_path())
    ids = lambda t: hashlib.sha256(np.array(coder.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    texts = {i: t for i, t, _ in left}
    assert got == Counter({(i, ids(texts[i])): n for i, n in mixed_by_hand(left).items()})
    assert len(rows) > len(known) > len(first) > len(left)


CLASHING = ["__mix", "__copy", "__words", "__text", "__id", "doc", "text_sha256", "copies", "last", "room", "of", "shuffle", "locator", "score", "lang_pred"]


def test_stages_keep_columns_of_any_name_and_take_odd_rows(spark, tmp_path):
    rows = [*documents(4)[:60], (7, "the house and this river that people were", "aa", "s1"), (7, "the house and this river that people were", "aa", "s1"), (None, "хорошо дом река люди", "bb", None), (3, "la maison " * 4_000, "cc", "s2")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    frame = frame.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns, name
        kept = out.collect()
        assert kept and {(r.doc_id, r.text) for r in kept} <= {(i, t) for i, t, *_ in rows}, name
        assert all([r[c] for c in CLASHING] == list(range(len(CLASHING))) for r in kept), name
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0, name
    assert mixing.EPOCHS == 3 and os.path.exists(tokenizer_path())
