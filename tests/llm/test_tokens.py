import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import common, packing, token_counts, tokens


def brute(texts):
    t = Tokenizer.from_file(tokens.default_path())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab' 1,\n\t \u0085\x1céß漢<|endoftext|>"), max_size=40), max_size=5))
def test_pieces_give_the_library_ids(texts):
    enc = tokens.encoder(tokens.default_path())
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.ids(texts)] == brute(texts)
    assert enc.counts(texts) == [len(x) for x in brute(texts)]


def test_long_text_in_sections(monkeypatch):
    text = " ".join(["some words, and  gaps\n", "x" * 30] * 50)
    assert "".join(tokens._sections(text, 100)) == text
    monkeypatch.setattr(tokens._sections, "__defaults__", (100,))
    monkeypatch.setattr(tokens, "_SECTION", 100)
    enc = tokens.Encoder(tokens.default_path(), most=20)
    assert enc.counts([text, "a b"]) == [len(x) for x in brute([text, "a b"])]


def test_counts(spark, make, odd_texts, tmp_path):
    docs = make(odd_texts).union(make([(None, "null id"), (3, "a")]))
    docs = docs.selectExpr("*", "1 as n_tokens", "2 as content_digest", "3 as body")
    path = f"file://{tmp_path}/cache"
    want = sorted((i, len((t or "").encode()), len(b)) for i, t, b in zip([*range(len(odd_texts)), -1, 3], [*odd_texts, "null id", "a"], brute([*odd_texts, "null id", "a"]), strict=True))
    for _ in range(2):  # the second run finds all in the cache
        got = token_counts.count_tokens(docs, cache_path=path).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert spark.read.parquet(path).count() == len({t or "" for t in [*odd_texts, "null id"]})
    assert token_counts.count_tokens(docs.limit(0), cache_path=f"{path}2").count() == 0


def test_other_tokenizers(make, odd_texts):
    import public_tokenizers as P
    import sentencepiece

    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(make(odd_texts), P.path("piece_bpe_32k.model")).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert got == {i: len(lib.encode(t or "")) for i, t in enumerate(odd_texts)}
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(make(odd_texts), P.path("word_bpe_49k.json")).collect()}
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert got == {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(odd_texts)}


def least_bins(items, capacity):
    """Exact, for a few items."""
    best = len(items)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins) if b + items[k] <= capacity}.values():
            go(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_an_optimum(items):
    counts = {s: items.count(s) for s in items}
    fixed, left = packing.reduce_by_dominance(counts, 20)
    rest = sorted((s for s, n in left.items() for _ in range(n)), reverse=True)
    assert sum(n for _, n in fixed) + least_bins(rest, 20) == least_bins(sorted(items, reverse=True), 20)
    bins = packing.solve(counts, 20)
    assert sorted(s for b, n in bins for s in b for _ in range(n)) == sorted(items)
    assert all(sum(b) <= 20 for b, _ in bins)
    one = []
    for s in sorted(rest, reverse=True):  # the bulk form equals best fit item by item
        fit = [i for i, b in enumerate(one) if sum(b) + s <= 20]
        if fit:
            one[max(fit, key=lambda i: sum(one[i]))].append(s)
        else:
            one.append([s])
    assert sum(n for _, n in packing.best_fit(left, 20)) == len(one)


def test_pack(spark, make, odd_texts):
    docs = make(odd_texts + ["same text"] * 40).selectExpr("*", "1 as length", "2 as piece", "3 as g")
    got = packing.pack(docs, rows_per_group=3).collect()
    texts = odd_texts + ["same text"] * 40
    want = {}
    for i, ids in enumerate(brute(texts)):
        ids = [*ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(s[-1]) <= 1024
    packed = packing.pack(docs)
    made = {r.sequence_id: r for r in packing.sequences(docs, packed).collect()}
    assert sum(len(r.ids) // 4 for r in made.values()) == sum(len(b) + 1 for b in brute(texts))
    assert packing.pack(docs.limit(0)).count() == 0


def test_sequences_of_repeated_and_null_ids(spark, make):
    """As after mixing: a document twice, several texts under one id and under none. Every place is filled once, by its own ids."""
    long = " ".join(f"w{i}" for i in range(900))
    rows = [(1, "one text"), (1, "one text"), (2, long), (2, long), (3, "a b"), (3, "another one"), (None, "x"), (None, "x"), (None, "y z"), (None, None), (4, None)]
    docs = make(rows)
    packed = common.materialise(packing.pack(docs, rows_per_group=2), "packed")
    cut = []
    for ids in brute([t for _, t in rows]):
        ids = [*ids, 2]
        at = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        cut += [tuple(ids[a:b]) for a, b in zip(at, at[1:], strict=False)]
    made = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(docs, packed).collect()}
    got = [tuple(made[r.sequence_id][r.offset : r.offset + r.length]) for r in packed.collect()]
    assert sorted(got) == sorted(cut) and sum(map(len, made.values())) == sum(map(len, cut))


def test_every_latin_word_and_mark():
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x250)] if c not in (0xD7, 0xF7)]
    texts = [" ".join(a + b + m for a, b in zip(letters, letters[k:], strict=False)) for k in (1, 7) for m in ("", ".", "!!", "***,", "$$$\n", "'s")]
    enc = tokens.encoder(tokens.default_path())
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.ids(texts)] == brute(texts)
