import hashlib
import itertools
import random
import re

from stratalog.llm import personal

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "", re.ASCII) if good(k, m[0])]


TEXTS = [
    None, "", "é a.b@c.d-e.f, x@y @z.w a@b.cx_y@d.ef q@r@s.t", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.255.0 1.2.3", "4539 1488 0343 6467 and 4539-1488-0343-6468 4539148803436467000",
    "+1 (555) 123-4567 x +1 2 +49 30 123456789012345678 ++33 1 23 45 67 89.", "call 555-123-4567 or ssn 123-45-6789 now; mail me (at) host [dot] com", "😀 4539148803436467 😀a@b.co", "1" * 30_000, "a" * 60_000 + "@", "1 " * 20_000, "1.1." * 9_000, "x@y.z " * 300,
    "version 555-123-4567", "0.0.0.0 99999999999999999999.1.1.1",
]


def test_base_spans_match_brute_force(docs):
    out = {r.doc_id: r for r in personal.report(personal.detected(docs([(i, t, None) for i, t in enumerate(TEXTS)]))).collect()}
    for i, t in enumerate(TEXTS):
        spans = brute(t)
        assert out[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (t or "")[:60]
        assert [out[i].n_email, out[i].n_ip, out[i].n_card, out[i].n_phone] == [sum(s.startswith(k) for s in spans) for k in BASE]
        assert set(spans) <= set(filter(None, out[i].spans.split(",")))
    assert "ssn" not in out[13].spans and out[13].spans == ""


def test_masking_and_empty(docs):
    assert personal.detected(docs([])).count() == 0
    assert personal.detected(docs([(1, "nothing here", None)])).first().spans == []
    out = personal.masked(docs([(1, "é a@b.co and +1 555 123 4567.", None), (2, None, None)])).collect()
    assert sorted(out) == [(1, "é [PII] and [PII]."), (2, "")]


def test_reliabilities_of_independent_labelers_are_recovered(spark):
    prior, rates = 0.4, {"structure": (0.95, 0.2), "gazetteer": (0.8, 0.3), "context": (0.7, 0.1), "border": (0.9, 0.55)}
    rows = []
    for votes in itertools.product((1, 0), repeat=4):
        true, false = prior, 1 - prior
        for v, (t, f) in zip(votes, rates.values(), strict=True):
            true, false = true * (t if v else 1 - t), false * (f if v else 1 - f)
        rows.append((0, *votes, round(1e6 * (true + false))))
    got_prior, got = personal.reliabilities(spark.createDataFrame(rows, "kind int, structure int, gazetteer int, context int, border int, n bigint"))
    assert abs(got_prior - prior) < 0.1
    for name, (t, f) in rates.items():
        assert abs(got[name][0] - t) < 0.1 and abs(got[name][1] - f) < 0.1, (name, got[name])


def test_labelers_that_abstain_change_nothing(spark):
    votes = spark.createDataFrame([(0, -1, -1, -1, -1, 10)], "kind int, structure int, gazetteer int, context int, border int, n bigint")
    p = votes.select(personal.posterior(0.3, {n: (0.9, 0.1) for n in personal.LABELERS})).first()[0]
    assert abs(p - 0.3) < 1e-12


def test_the_method_adds_spans_and_leaves_clean_texts_alone(docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    prose = lambda: " ".join(word() for _ in range(30))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    plants = [lambda: f'token = "{hexes(40)}"', lambda: f"password={hexes(18)}", lambda: "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(16)), lambda: f"{word()}@{word()}.com", lambda: "+1 (555) 123-4567", lambda: "93.101.184.67"]
    rows, planted = [], set()
    for i in range(240):
        text = prose()
        if i % 4 == 0:
            planted.add(i)
            text += f" {plants[i // 4 % len(plants)]()} {prose()}"
        rows.append((i, text, None))
    rows += [(1000, "a version-2024-build-17-of-it and 1234567890123456 and half-a-dozen-long-words", None), (1001, "x" * 50_000 + "1", None)]
    out = {r.doc_id: r for r in personal.report(personal.detected(docs(rows))).collect()}
    found = {i for i, r in out.items() if r.n_spans}
    assert planted <= found
    assert not (found - planted) & set(range(240)), sorted(found - planted)
    kinds = {s.split(":")[0] for r in out.values() for s in filter(None, r.spans.split(","))}
    assert "secret" in kinds
    text = next(t for i, t, _ in rows if i == 0)
    start = text.index('"') + 1
    assert f"secret:{start}:{start + 40}" in out[0].spans


def test_many_matches_and_repeated_rows(docs):
    text = " ".join(f"a{k}@b.co" for k in range(3_000))
    out = personal.report(personal.detected(docs([(1, text, None), (1, text, None), (2, "", None)]))).collect()
    assert sorted((r.doc_id, r.n_email) for r in out) == [(1, 3_000), (1, 3_000), (2, 0)]
    assert {r.base_sha256 for r in out if r.doc_id == 1} == {hashlib.sha256(",".join(brute(text)).encode()).hexdigest()}
