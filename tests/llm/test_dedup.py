import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import awkward, empty, shingles
from vedette.llm import minhash, repeats
from vedette.llm.components import components
from vedette.llm.textkit import Words


def near_truth(rows, k, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, shingles(t, k))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def families(seed=3, n=25):
    """Originals with copies of copies: chains whose ends are not similar any more."""
    rng = random.Random(seed)
    out, i = [], 100
    for _ in range(n):
        text = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 8)):
            out.append((i, " ".join(text)))
            i += 1
            text = list(text)
            for _ in range(rng.randrange(0, 3)):
                text[rng.randrange(len(text))] = f"v{rng.randrange(3000)}"
    return out


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    docs = awkward(spark, families())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = near_truth(rows, k, percent)
    got = minhash.near_duplicates(docs.repartition(5), k, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    left = minhash.one_of_each(docs, k, percent)
    assert left.columns == docs.columns
    once = collections.Counter(str(r.doc_id) for r in got if r.kept) - collections.Counter(["2"])  # its rows repeat
    assert collections.Counter(str(r.doc_id) for r in left.collect()) == once


def by_text(rows, k, percent):
    """Truth for tables whose doc_ids repeat: every row goes by its own text; the smallest doc_id among linked texts."""
    sets = sorted({(i, shingles(t, k)) for i, t in rows if i is not None and shingles(t, k)}, key=lambda x: (x[0], sorted(x[1])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            n = len(sets[a][1] & sets[b][1])
            if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {s: sets[find(n)][0] for n, s in enumerate(sets)}


def test_doc_ids_that_repeat(spark):
    """Rows go by their own text: none of a repeated id's texts lends its set to another, or takes its rows along."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, c), (4, c), (5, c + " x"), (4, a), (6, ""), (6, ""), (None, c), (None, c), (7, c + " y"), (7, b + " y")]
    more = [(i + i % 3 * 500, t) for i, t in families(5, 8)] + [(i // 2, t) for i, t in families(6, 8)]
    for table in (rows, rows + more):
        df = spark.createDataFrame([(*r, n) for n, r in enumerate(table)], "doc_id long, text string, _b int")
        want = by_text(table, 5, 80)
        got = minhash.near_duplicates(df.repartition(3), 5, 80)
        assert sorted((r.doc_id, r.component_id) for r in got.where("doc_id is not null and n_shingles > 0").collect()) == sorted((i, want[i, shingles(t, 5)]) for i, t in table if i is not None and shingles(t, 5))
        left = [(r.doc_id, r.text) for r in minhash.one_of_each(df, 5, 80).collect()]
        assert sum(t == "" for _, t in left) == 2 and sum(i is None for i, _ in left) == 2
        kept = [(i, shingles(t, 5)) for i, t in left if i is not None and t]
        groups = [x for x in kept if not any(100 * len(x[1] & y[1]) >= 80 * len(x[1] | y[1]) for y in kept if y is not x)]
        assert groups == kept and all(want[x] == x[0] for x in kept)  # nobody near anybody, each with its component's id
        assert {want[x] for x in want} == {i for i, _ in kept}


def test_stars_miss_nothing(spark):
    """A family around a centre whose far members are similar to near members only."""
    rng = random.Random(1)
    centre = [f"c{i}" for i in range(200)]
    rows = [(0, " ".join(centre))]
    for i in range(1, 40):
        text = list(centre)
        for _ in range(rng.randrange(1, 12)):
            text[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        rows.append((2 * i, " ".join(text)))
        for _ in range(2):
            text[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        rows.append((2 * i + 1, " ".join(text)))
    want = near_truth(rows, 3, 85)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: c for i, (_, c) in want.items()}
    assert len(set(c for _, c in want.values())) > 1


def test_missed_pairs_are_found_by_differences(spark):
    sets = {0: set(range(100)), 1: set(range(100)) - {0, 1, 2, 3, 4} | {200, 201, 202, 203, 204}, 2: set(range(8, 100)) | set(range(200, 212))}
    frame = spark.createDataFrame([((i, 7), bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in sets.items()], f"node {minhash.NODE}, shingles binary")
    pairs = spark.createDataFrame([((0, 7), (1, 7)), ((0, 7), (2, 7))], f"centre {minhash.NODE}, member {minhash.NODE}")
    tested = minhash.confirmed(pairs, frame, 85, differences=True).persist()
    assert {(r.v.id, r.linked) for r in tested.collect()} == {(1, True), (2, False)}
    labels = components(tested.where("linked").select("u", "v"))
    missed = {tuple(sorted((r.centre.id, r.member.id))) for r in minhash.missed_by_stars(tested, labels).collect()}
    assert (1, 2) in missed


def test_densified_signatures_agree_as_the_sets_do():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 2**63, 900, dtype=np.uint64)
    h = np.concatenate([np.sort(np.append(common, rng.integers(0, 2**63, 100, dtype=np.uint64))) for _ in range(2)])
    s = minhash.densified(h, np.repeat([0, 1], 1000), 2, 180)
    assert 0.7 < (s[0] == s[1]).mean() < 0.93
    few = minhash.densified(h[[0, 500, 900]], np.zeros(3, int), 2, 180)
    assert len(set(few[0].tolist())) == 3 and (few[1] == 2**64 - 1).all()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got[i] for i in range(31)) == {0} and set(got[i] for i in range(100, 140)) == {100}


def test_words_and_shingles():
    column = pa.array(["A b\tC", None, "", "x", "a  b c d"], pa.large_string())
    w = Words(column)
    assert w.count.tolist() == [3, 0, 0, 1, 4] and w.hash[0] == w.hash[4] and w.hash[1] == w.hash[5]
    h, doc = w.shingles(3)
    assert sorted(doc.tolist()) == [0, 3, 4, 4] and h[list(doc).index(0)] == h[list(doc).index(4)]


def repeat_truth(rows):
    docs = {}
    for i, t in rows:
        docs[-1 if i is None else i, hashlib.md5((t or "").encode()).hexdigest()] = (t or "").encode()
    seen, out = set(), {}
    for key in sorted(docs, key=lambda k: k[0]):
        b = docs[key]
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[key[0], b] = (len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), hashlib.sha256(kept).hexdigest())
    return out


def shared_passages(seed=2):
    rng = random.Random(seed)
    letters = "abcdefghijklmnop "
    passage = ["".join(rng.choice(letters) for _ in range(n)) for n in (100, 101, 160, 400, 99)]
    out = []
    for i in range(60):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 150)))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passage)
            a = rng.randrange(0, 20)
            text += p[a : len(p) - rng.randrange(0, 20)] + "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))
        out.append((1000 + i, text))
    return [*out, (2000, "ab" * 200), (2001, "z" * 350), (2002, "-" * 99 + "é" * 80)]


@pytest.mark.parametrize("hot", [400, 3, 0])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = awkward(spark, shared_passages())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = repeat_truth([r for r in rows if r[0] is not None or r[1] is not None])
    got = collections.defaultdict(list)
    for r in repeats.removals(docs.repartition(7)).collect():
        got[-1 if r.doc_id is None else r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        assert want.get((-1 if i is None else i, (t or "").encode()), (0, 0, 0, hashlib.sha256(b"").hexdigest())) in got[-1 if i is None else i], i


def test_intervals_are_all_of_the_tree():
    lcp = np.array([0, 3, 5, 5, 3, 0, 2])
    got = sorted(repeats.intervals(lcp))
    assert got == [(0, 4, 3, 0), (1, 3, 5, 3), (5, 6, 2, 0)]


def test_empty_tables(spark):
    assert minhash.near_duplicates(empty(spark), 3, 85).count() == 0 and repeats.removals(empty(spark)).count() == 0
    assert minhash.one_of_each(empty(spark)).count() == 0
