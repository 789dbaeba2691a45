from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratalog.llm import mixing


def by_hand(plan):
    """(doc_id, source, size) -> copies, of which no less than half lies before the source's cut."""
    out = Counter()
    for r in plan.collect():
        n = sum(2 * (int(r.target) - r.start - e * r.source_size) >= r.size > 0 for e in range(mixing.EPOCHS))
        out[r.doc_id, r.source, r.size] += n
    return +out


def test_documents_are_whole_at_the_cut(docs):
    rows = [(i, f"a{i} \t b " + "w  " * (i * 7 % 50), f"s{i % 5}" if i % 5 else None) for i in range(400)]
    rows += [(900, "long  " * 3000, "s1"), (901, "", "s1"), (902, None, "s2"), (903, "one", "tiny")]
    frame = docs(rows).withColumn("n_chars", F.length("text"))
    plan, out = mixing.schedule(frame), mixing.mixed(frame).collect()
    whole = {(i, t) for i, t, _ in rows}
    assert all((r.doc_id, r.text) in whole and r.n_chars == len(r.text) for r in out)
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in out) == by_hand(plan)
    words, longest = Counter(), Counter()
    for r in out:
        words[r.source] += len(r.text.split())
    for r in plan.collect():
        longest[r.source] = max(longest[r.source], r.size)
    assert all(abs(words[r.source] - r.target) <= longest[r.source] / 2 + 1 for r in plan.collect())


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: i % 2, lambda i: i if i % 4 else None])
def test_rows_with_null_or_equal_ids_have_their_own_places(docs, ids):
    rows = [(ids(i), f"t{i} " + "w " * (i % 3), "x" if i % 3 else "y") for i in range(120)] + [(1, "z", None)]
    frame = docs(rows)
    out = mixing.mixed(frame).collect()
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in out) == by_hand(mixing.schedule(frame))
    assert {(r.doc_id, r.text) for r in out} <= {(i, t) for i, t, _ in rows}
    assert Counter(tuple(r) for r in out) == Counter(tuple(r) for r in mixing.mixed(frame.repartition(5)).collect())
