import itertools
import random
import re

from pyspark.sql import functions as F

from stratalog.llm import exact_dedup, near_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def exact_brute(rows):
    norm = {k: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for k, (_, t) in enumerate(rows)}
    out = []
    for k, (i, _) in enumerate(rows):
        same = [j for m, (j, _) in enumerate(rows) if norm[m] == norm[k]]
        ids = [j for j in same if j is not None]
        out.append((i, min(ids) if ids else None, len(same)))
    return sorted(out, key=str)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, None), (8, ""), (7, " "), (1, "x"), (3, "a b"), (None, "x"), (None, "only"), (11, "é" * 50_000), (12, "é" * 50_000)]


def test_exact_dedup_matches_brute_force(docs):
    out = exact_dedup.decisions(docs([(i, t, None) for i, t in ROWS])).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in out), key=str) == exact_brute(ROWS)
    assert sum(r.kept for r in out) == len({r.text_sha256 for r in out})


def test_exact_dedup_collisions_are_told_apart_by_full_bytes(docs):
    weak = lambda text: F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 2))
    rows = [(i, f"t{i % 150}") for i in range(400)]
    out = exact_dedup.decisions(docs([(i, t, None) for i, t in rows]), digest=weak).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in out), key=str) == exact_brute(rows)


def test_exact_dedup_state_lives_across_batches(spark, docs):
    rows = docs([(i, f"t{i % 7}", None) for i in range(60)]).repartition(6)
    out = exact_dedup.decisions(rows, files_per_batch=1).collect()
    assert {(r.keep_id, r.doc_id % 7) for r in out} == {(i, i) for i in range(7)}


def test_exact_dedup_empty_table_and_dropping(docs):
    assert exact_dedup.decisions(docs([])).count() == 0
    left = exact_dedup.drop_copies(docs([(i, t, None) for i, t in ROWS]))
    assert left.columns == docs([]).columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([3, 8, 7, 1, None, 11], key=str)


def near_brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def near_cases(seed=5, groups=25):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))] + passage * (g % 3 == 0)
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 8)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w))
            base = w if g % 4 == 0 else base
    rows += ["", None, "  ", "One", "one", "a b", "A  B", "a", "z " * 30_000]
    rng.shuffle(rows)
    return [(3 * k, t) for k, t in enumerate(rows)]


def test_near_dedup_matches_brute_force(docs):
    for width, seed in ((2, 5), (5, 6)):
        rows = near_cases(seed)
        out = near_dedup.near_duplicates(docs([(i, t, None) for i, t in rows]), like=near_dedup.Likeness(width, 80)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == near_brute(rows, width, 80)


def test_near_dedup_finds_links_off_the_hub(docs):
    # few, wide bands put unlike texts together, so links lie between members that miss the hub
    rows = near_cases(9, 40)
    out = near_dedup.near_duplicates(docs([(i, t, None) for i, t in rows]), like=near_dedup.Likeness(2, 80), bands=128, rows=1).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == near_brute(rows, 2, 80)


def test_near_dedup_repeated_and_empty(docs):
    assert near_dedup.near_duplicates(docs([])).count() == 0
    out = near_dedup.near_duplicates(docs([(4, "a b c", None), (4, "a b c", None), (None, "a b c", None)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in out) == [("4", "4", True), ("4", "4", True), ("None", "None", True)]


def test_components_of_a_long_chain(spark):
    from stratalog.llm.scratch import Scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.root for r in near_dedup.components(edges, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_exact_dedup_goes_on_where_an_earlier_call_ended(docs, tmp_path):
    state = str(tmp_path / "state")
    first = exact_dedup.decisions(docs([(5, "a b", None), (6, "c", None)]), state=state).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in first} == {(5, 5, True), (6, 6, True)}
    later = exact_dedup.decisions(docs([(7, "a  b", None), (8, "d", None), (2, "c", None)]), state=state).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in later} == {(7, 5, 2, False), (8, 8, 1, True), (2, 2, 2, True)}


def test_dropping_keeps_columns_of_any_name(spark):
    names = "doc_id bigint, text string, doc int, locator string, digest int, first int, __text string, __id int"
    rows = [(1, "a", 1, "l", 2, 3, "t", 4), (1, "a", 9, "l", 2, 3, "t", 4), (1, "b", 5, "l", 2, 3, "t", 4), (None, "b", 6, "l", 2, 3, "t", 4), (2, None, 7, "l", 2, 3, "t", 4), (3, "", 8, "l", 2, 3, "t", 4)]
    left = exact_dedup.drop_copies(spark.createDataFrame(rows, names))
    assert left.columns == [c.split()[0] for c in names.split(", ")]
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(1, "a"), (1, "b"), (2, None)], key=lambda x: x[0]) or sorted((r.doc_id, r.text or "") for r in left.collect()) == [(1, "a"), (1, "b"), (2, "")]


def test_near_dedup_null_texts_and_dropping(docs):
    rows = [(1, None, None), (2, None, None), (3, "", None), (4, "a b c d e f g", "s"), (5, "A b c d e f g", "s"), (6, "a b c d e f g", "t")]
    out = near_dedup.near_duplicates(docs(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 3, 4, True), (5, 3, 4, False), (6, 3, 4, False)]
    left = near_dedup.drop_near_copies(docs(rows))
    assert left.columns == docs([]).columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4]
    assert near_dedup.drop_near_copies(docs([])).count() == 0
