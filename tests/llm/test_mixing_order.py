import math

from stratalog.llm import mixing


def test_closed_form_equals_the_sorted_mix(docs):
    """Every repeat in one virtual time, cut where the budget is spent, against `taken`."""
    plan = mixing.schedule(docs([(i, "w " * (1 + i % 40), f"s{i % 6}" if i % 6 else None) for i in range(600)] + [(1001, "one two", "tiny")])).collect()
    horizon = max(r.target / r.weight for r in plan)
    copies = sorted(((r.start + r.size + e * r.source_size) / r.weight, r.doc_id, r.size, r.weight) for r in plan for e in range(mixing.EPOCHS))
    words = dict.fromkeys((r.doc_id for r in plan), 0)
    for finish, i, size, weight in copies:
        words[i] += size if finish <= horizon else max(0, size - math.ceil((finish - horizon) * weight))
    assert words == {r.doc_id: r.taken for r in plan}
