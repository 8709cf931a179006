import hashlib
import random

from folioscan.llm.fingerprints import Fingerprint, edited, edited_fingerprint, fingerprint_edits, likeness, paragraphs

SCHEMA = "doc_id long, text string, segment int, own int, near_next string"


def test_order_insertion_and_deletion():
    a, b = Fingerprint(["x", "y", "z", "x"]), Fingerprint(["z", "x", "x", "y"])
    assert a == b and a.text() == b.text() and len(a.text()) == 640
    assert a != Fingerprint(["x", "y", "z"])
    assert a.copy().add(["new"]).remove(["new"]) == a == b
    assert a.copy().remove(["x"]) == Fingerprint(["x", "y", "z"])
    assert Fingerprint(["q"] * 70_000).remove(["q"] * 70_000) == Fingerprint()


def test_likeness_follows_what_is_shared():
    lines = [f"line {i}" for i in range(200)]
    whole = Fingerprint(lines)
    assert likeness(whole, whole) == 1 and likeness(Fingerprint(), Fingerprint()) == 1
    assert abs(likeness(whole, Fingerprint(lines[:150] + [f"new {i}" for i in range(50)])) - 0.75) < 0.1
    assert likeness(whole, Fingerprint(f"other {i}" for i in range(200))) < 0.2
    assert likeness(whole, Fingerprint()) == 0


def test_edits_exchange_only_what_changed():
    rng = random.Random(1)
    for _ in range(200):
        text, after = ("".join(rng.choice("ab.\n ") for _ in range(rng.randint(0, 40))) for _ in range(2))
        changed = edited(text, after)
        keep = len(text) - len(text) // 2
        assert edited_fingerprint(Fingerprint(paragraphs(text)), text, changed, keep) == Fingerprint(paragraphs(changed))


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for i, (id_, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        changed = edited(text, after)
        own, other, nxt = (Fingerprint(paragraphs(t)) for t in (text, changed, after))
        out.append((id_, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.text(), other.text(), likeness(own, other), likeness(own, nxt)))
    return sorted(out, key=repr)


def run(table, rows, **kw):
    found = fingerprint_edits(table([(i, t, 3, 4, "x") for i, t in rows], SCHEMA), **kw)
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_against_brute_force(table):
    rng = random.Random(2)
    rows = [(rng.randint(-(10**12), 10**12), "\n".join(rng.choice(["Über.", "a b c", "𝔘nicode 😀", ""]) for _ in range(rng.randint(0, 9)))) for _ in range(300)]
    rows += [(5, None), (6, ""), (7, "long. " * 100_000), (8, "same"), (9, "same")]
    assert run(table, rows) == brute(rows)
    assert run(table, rows, segments=50) == brute(rows)


def test_repeated_null_and_few_ids(table):
    rows = [(1, "a"), (1, "b"), (1, None), (2, "c"), (None, "d"), (None, "e")]
    assert run(table, rows) == brute(rows)
    assert run(table, [(None, "x"), (None, "y")]) == brute([(None, "x"), (None, "y")])
    assert run(table, [(4, "alone. text")]) == brute([(4, "alone. text")])
    assert run(table, []) == []
