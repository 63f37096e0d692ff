import hashlib
import random

import numpy as np
import pytest

from tessera.llm import common, fingerprints, near_dedup


def shingles(text, width):
    w = [x.decode() for x in common.words(text)]
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in w]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, percent=80):
    """(doc_id, size, component, kept) of each row; rows with one id are one document."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if None not in (i, j) and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=repr)


def corpus(seed, families=6, size=14, words=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    rows = []
    passage = [rng.choice(vocab) for _ in range(40)]
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(words)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(0, 9)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append(" ".join(t))
    for _ in range(40):  # many documents share a passage that is most of them
        rows.append(" ".join(passage + [rng.choice(vocab) for _ in range(rng.randrange(2, 16))]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(spark, make, width):
    texts = corpus(width) + ["", None, " \n", "One", "one", "two words", "TWO words", "x" * 30000, "a " * 20000, "a a", "same set a b a b", "same set a b a b a b"]
    rows = list(enumerate(texts))
    df = make(rows).selectExpr("*", "1 as rep", "2 as component", "3 as n_shingles", "4 as key")
    got = near_dedup.near_duplicates(df, width)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=repr) == brute(rows, width)


def test_few_hubs_a_round_give_the_same(spark, make):
    rows = list(enumerate(corpus(9, families=1, size=16, words=30)[:30]))
    got = near_dedup.near_duplicates(make(rows), 2, hubs=4)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=repr) == brute(rows, 2)


def test_null_and_repeated_ids(spark, make):
    rows = [(5, "a b c d e f"), (5, "g h i j k l"), (3, "a b c d e f"), (9, "g h i j k l"), (None, "a b c d e f"), (None, None), (7, ""), (7, ""), (3, "a b c d e f")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(make(rows), 2).collect()), key=repr)
    assert got == brute(rows, 2)
    kept = near_dedup.deduplicate(make(rows), 2)
    assert kept.columns == make(rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 7, None, None], key=repr)
    assert near_dedup.near_duplicates(make(rows).limit(0)).count() == 0 and near_dedup.deduplicate(make(rows).limit(0)).count() == 0


def test_pruning_is_sound():
    rng = np.random.default_rng(0)
    pruned = 0
    for n in (1, 5, 40, 300, 900, 5000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(n) < p], rng.integers(0, 2**63, int(n * (1 - p)) + 1).astype(np.uint64)])) for p in (0.7, 0.85, 0.9, 0.95, 1.0)]
        i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
        size, bits = np.array([len(s) for s in sets]), [near_dedup.bitmap(s).tobytes() for s in sets]
        fits = near_dedup.near_size(size[i], size[j], 80)
        i, j = i[fits], j[fits]
        kept = near_dedup.near_bits(size[i] + size[j], near_dedup.bits_apart([bits[k] for k in i], [bits[k] for k in j]), 80)
        pruned += int((~kept).sum())
        may = set(zip(i[kept].tolist(), j[kept].tolist(), strict=True))
        for x, a in enumerate(sets):
            for y, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    assert (x, y) in may
    assert pruned > 10


def test_first_shared_table():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (200, near_dedup.COLLECTIONS)).astype(np.uint64)
    y = rng.integers(0, 3, (200, near_dedup.COLLECTIONS)).astype(np.uint64)
    left, right = np.triu_indices(near_dedup.COLLECTIONS, 1)
    for got, a, b in zip(near_dedup.first_table(x, y), x, y, strict=True):
        shared = [t for t in range(len(left)) if a[left[t]] == b[left[t]] and a[right[t]] == b[right[t]]]
        assert got == (shared[0] if shared else -1)


def test_verified_pairs_grow_with_the_group_and_not_its_square(spark, make, monkeypatch):
    """One group of near copies at two sizes: the rows of every table of pairs."""
    made = {}
    write = common.materialise
    for size in (100, 400):
        rng = random.Random(size)
        vocab = [f"w{i}" for i in range(4000)]
        base = [rng.choice(vocab) for _ in range(300)]
        rows = []
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(0, 24)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append(" ".join(t))
        counts = []

        def counted(df, label, counts=counts):
            out = write(df, label)
            if label == "pairs":
                counts.append(out.count())
            return out

        monkeypatch.setattr(common, "materialise", counted)
        rows = list(enumerate(rows))
        got = near_dedup.near_duplicates(make(rows), 2)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=repr) == brute(rows, 2)
        made[size] = sum(counts)
    assert all(n < 5 * size for size, n in made.items()), made


def test_a_split_bucket_gives_the_same(spark, make, monkeypatch):
    """Buckets over several tasks, joins with split keys."""
    monkeypatch.setattr(common, "SPREAD", 3)
    rows = list(enumerate(corpus(11, families=1, size=20, words=30)[:40] + ["a b c d e f"] * 12))
    got = near_dedup.near_duplicates(make(rows), 2, hubs=8, spread=5)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=repr) == brute(rows, 2)


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, k) for k in range(1001, 1400)] + [(k, k + 1) for k in range(2000, 2100)] + [(None, 5), (7, None), (8, 8)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if None not in (a, b) and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = common.connected_components(spark.createDataFrame(pairs, "a long, b long"), spread=50).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chance_of_sharing_a_table():
    """At the similarity of 0.8 nearly every pair shares two collections."""
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(400):
        both, own = rng.integers(0, 2**63, 80).astype(np.uint64), rng.integers(0, 2**63, 20).astype(np.uint64)
        a, b = np.concatenate([both, own[:10]]), np.concatenate([both, own[10:]])
        x = near_dedup.collections_of([np.unique(a), np.unique(b)])
        missed += (x[0] == x[1]).sum() < 2
    assert missed <= 2


def brute_sketch(text):
    x = [ord(c) for c in text] + [fingerprints._PAD] * max(0, fingerprints.WIDTH - len(text))
    if not text:
        return set()
    out = set()
    for i in range(len(x) - fingerprints.WIDTH + 1):
        h = sum((x[i + j] + 1) * int(fingerprints._MULTIPLIERS[j]) for j in range(fingerprints.WIDTH)) % 2**64
        h ^= h >> 32
        h = h * 0x9E3779B97F4A7C15 % 2**64
        h ^= h >> 29
        if h < 2**64 // fingerprints.FRACTION:
            out.add(h)
    return out


def test_fingerprints_equal_brute_force(spark, make, odd_texts, monkeypatch):
    texts = odd_texts + corpus(3, 2, 6) + ["dup", "dup"]
    rows = [*((3 * i - 5, t) for i, t in enumerate(texts)), (4, "tie b"), (4, "tie a"), (None, "null id"), (4, "tie a")]
    got = fingerprints.fingerprint(make(rows).selectExpr("*", "1 as part", "2 as tail", "3 as at"), rows_per_part=5).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = brute_sketch(t), brute_sketch(edited), brute_sketch(after)
        like = lambda p, q, x, y: 1.0 if p == q else len(x & y) / len(x | y) if x | y else 0.0
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.encode(t, np.array(sorted(a), dtype=np.uint64)), fingerprints.encode(edited, np.array(sorted(b), dtype=np.uint64)), like(t, edited, a, b), like(t, after, a, c)))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got), key=repr) == sorted(want, key=repr)
    assert fingerprints.fingerprint(make(rows).limit(0)).count() == 0
    one = fingerprints.fingerprint(make([(1, "only document here")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_blocks_merge_and_containment(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghij klmno") for _ in range(26_000))
    whole = fingerprints.sketches([text])[0]
    monkeypatch.setattr(fingerprints, "_BLOCK", 1000)
    assert np.array_equal(fingerprints.sketches([text, "short"])[0], whole)
    a, b = fingerprints.encode(text[:9000], fingerprints.sketches([text[:9000]])[0]), fingerprints.encode(text, whole)
    every = [set(x.tolist()) for x in fingerprints.sketches([text[:9000], text], fraction=1)]  # all shingles, for the true likeness
    assert fingerprints.compare(a, b)[1] == 1.0 and abs(fingerprints.compare(a, b)[0] - len(every[0] & every[1]) / len(every[0] | every[1])) < 0.05
    assert set(fingerprints.merge([a, b]).tolist()) == set(whole.tolist())
