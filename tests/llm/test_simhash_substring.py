import hashlib
import random

from pyspark.sql import Row

from reportmill.llm import simhash, substring


def brute_removed(rows, window=50):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - window + 1):
            o = first.get(tuple(w[s : s + window]))
            if o is not None and (i is None or o < i):
                gone |= set(range(s, s + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("ab cd ef gh ij kl mn op qr st uv wx yz é ü".split()) + str(r.randrange(40))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 130)]
    rows = []
    for i in range(120):
        w = [word() for _ in range(r.randrange(90))]
        for p in r.sample(passages, r.randrange(3)):
            at = r.randrange(len(w) + 1)
            w[at:at] = p
        rows.append((i, "\n ".join(w)))
    rows += [(200, "a " * 300), (201, "a " * 170), (202, None), (203, ""), (None, rows[3][1]), (None, None), rows[5], rows[5], (5, rows[6][1]), (204, "x" * 200_000), (205, " ".join(passages[4] * 3)), (2**63 - 1, " ".join(passages[3])), (-5, "z")]
    return rows


def test_substring_matches_brute_force(spark, monkeypatch):
    for block in (700, 1_000_000):
        monkeypatch.setattr(substring, "BLOCK_WORDS", block)
        rows = corpus(block)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = substring.removals(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=str) == brute_removed(rows)


def test_substring_empty_and_text(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, id string, key int")
    assert substring.removals(docs).count() == 0
    shared = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, shared, "u", 1), (2, f"one two\nthree {shared} four  five", "v", 2)], "doc_id long, text string, id string, key int")
    got = {r.doc_id: r for r in substring.without_repeats(docs).collect()}
    assert got[1].text == shared and got[2].text == "one two\nthree\nfour  five" and got[2].id == "v"


def brute_components(rows):
    fps = [(i, simhash.fingerprint((t or "").encode().lower().split()) % 2**64) for i, t in rows]
    comp = list(range(len(rows)))
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a][1] ^ fps[b][1]).bit_count() <= 2]
    for _ in rows:
        for a, b in near:
            comp[a] = comp[b] = min(comp[a], comp[b])
    low = {}
    for c, (i, _) in zip(comp, fps):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    return sorted(((i, f"{f:016x}", low.get(c)) for c, (i, f) in zip(comp, fps)), key=str)


def test_simhash_matches_brute_force(spark):
    r = random.Random(7)
    base = [" ".join(f"w{r.randrange(500)}" for _ in range(300)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        w = r.choice(base).split()
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = "x"
        rows.append((100 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "A b"), (303, "a B"), (None, base[0]), rows[0], (304, "é " * 70_000)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, fp=1, id="z") for i, t in rows], "doc_id long, text string, fp int, id string")
    got = [tuple(x) for x in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == brute_components(rows)
    kept = {x.doc_id for x in simhash.keep_one(docs).collect()}
    assert kept == {c for _, _, c in got} | {None}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_lists_join_everything_within_two_bits(spark):
    import numpy as np

    r = np.random.default_rng(3)
    centre = int(r.integers(0, 2**63))
    fps = sorted({centre ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in r.integers(0, 63, (400, 3))})
    label = {f: f for f in fps}
    near = [(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 2]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            if label[b] < label[a]:
                label[a], changed = label[b], True
    want = {k: v for k, v in label.items() if list(label.values()).count(v) > 1}
    for long in (simhash.LONG, 5):  # tallied lists only, and lists that are replaced
        got = simhash.connected_components(simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), long=long)).collect()
        assert {x.node: x.component for x in got} == want


def test_tallies_count_shared_positional_bytes():
    import numpy as np

    fps = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 40)
    fps[1::2] = fps[::2] ^ (1 << 17) ^ (1 << 40)
    want = [[sum(x == y for x, y in zip(int(a).to_bytes(8, "little", signed=True), int(b).to_bytes(8, "little", signed=True))) for b in fps] for a in fps]
    assert simhash.tallies(fps, fps).tolist() == want and want[0][1] == simhash.MATCHES
