import hashlib
import random

from stratalog.llm import substrings


def brute(rows, window):
    """By every window: the first place of each, in order of id and start."""
    first, out = {}, []
    for i, t in sorted(rows):
        b = (t or "").encode()
        for s in range(len(b) - window + 1):
            first.setdefault(b[s : s + window], (i, s))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if first[b[s : s + window]] != (i, s):
                gone[s : s + window] = b"\x01" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len([r for r in bytes(gone).split(b"\x00") if r]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def cases(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(4)]
    rows = ["", None, "short", "a" * 500, "a" * 99, "a" * 100, "ab" * 400, "é" * 300]
    for _ in range(60):
        parts = [text(rng.randrange(1, 30)) for _ in range(3)]
        for p in rng.sample(shared, rng.randrange(0, 3)):
            a = rng.randrange(0, 60)
            parts.insert(rng.randrange(3), p[a : a + rng.randrange(60, 200)])
        rows.append(" ".join(parts))
    rows += [rows[10], rows[11], rows[11] + "x", "y" + rows[11], rows[12][:150] + "!" + rows[12][150:], rows[13] * 2]
    rng.shuffle(rows)
    return [(5 * k, t) for k, t in enumerate(rows)]


def got(frame):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect())


def test_matches_brute_force(docs):
    rows = cases(1)
    assert got(substrings.cleaned(docs([(i, t, None) for i, t in rows]))) == brute(rows, 100)


def test_large_groups_are_aggregated_alike(docs):
    rows = cases(2)
    assert got(substrings.cleaned(docs([(i, t, None) for i, t in rows]), group=1)) == brute(rows, 100)


def test_empty_table(docs):
    assert substrings.cleaned(docs([])).count() == 0


def brute_rows(rows, window):
    """By every window of every row: the smallest id that holds it, and its first place in the row itself."""
    least, out = {}, []
    key = lambda i: substrings.LAST if i is None else i
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for i, b in bodies:
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            least[w] = min(least.get(w, substrings.LAST), key(i))
    for i, b in bodies:
        gone, seen = bytearray(len(b)), set()
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if least[w] < key(i) or w in seen:
                gone[s : s + window] = b"\x01" * window
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((str(i), len(b), sum(gone), len([r for r in bytes(gone).split(b"\x00") if r]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def by_row(frame):
    return sorted((str(i), *rest) for i, *rest in ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()))


def repeated_cases(seed, ids):
    rows = [(ids(i // 5), t) for i, t in cases(seed)]
    return rows + rows[::7] + [(None, rows[3][1]), (None, rows[20][1]), (None, rows[20][1])]


def test_rows_of_one_id_are_documents_of_their_own(docs):
    for ids, group in ((lambda k: k // 3, 2_000), (lambda k: 7 if k % 2 else k, 1), (lambda k: None, 3)):
        rows = repeated_cases(4, ids)
        assert by_row(substrings.cleaned(docs([(i, t, None) for i, t in rows]), group=group)) == brute_rows(rows, 100)


def test_an_anchor_of_many_contents(docs):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(130))
    rows = [(k, f"{rng.getrandbits(300):x} {passage} {rng.getrandbits(300):x}") for k in range(3000)]
    assert got(substrings.cleaned(docs([(i, t, None) for i, t in rows]), group=500)) == brute(rows, 100)


def test_long_texts_are_read_in_runs(docs, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE_BYTES", 700)
    rows = cases(3) + [(9001, " ".join(t or "" for _, t in cases(3))), (9003, "abcdefg " * 2_000)]
    assert got(substrings.cleaned(docs([(i, t, None) for i, t in rows]))) == brute(rows, 100)
