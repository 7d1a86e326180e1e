"""Text operators against plain Python, over nulls, blanks, ties, long texts and repeated rows."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import jaccard, lm, packing, quality, substring, tokens
from millrace.llm.common import by_range
from millrace.llm.components import components

from .conftest import TEXTS

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(t, lower=False):
    b = (t or "").encode()
    return (b.translate(LOWER) if lower else b).split()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_jaccard(texts, k, num, den):
    sets = []
    for _, t, _ in texts:
        w = words(t, True)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    n = len(texts)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    best = {}
    for i, (key, _, _) in enumerate(texts):
        if key is not None:
            best[root(i)] = min(best.get(root(i), key), key)
    return sorted(((texts[i][0], len(sets[i]), best.get(root(i)) if sets[i] else texts[i][0]) for i in range(n)), key=repr)


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_components(docs, k, num):
    assert rows(jaccard.jaccard_components(docs, k, num, 100)) == brute_jaccard(TEXTS, k, num, 100)


def test_jaccard_on_random_near_copies(spark):
    import random

    rng = random.Random(1)
    texts = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(rng.choice([12, 40, 150]))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append((len(texts), " ".join(w), "s"))
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    for k, num in ((3, 90), (5, 80)):
        assert rows(jaccard.jaccard_components(df, k, num, 100)) == brute_jaccard(texts, k, num, 100)


@pytest.mark.parametrize("again", ["same", "upper"])
def test_repeated_rows_do_not_add_to_an_overlap(spark, again):
    """Documents 1 and 2 share a rare passage, half of each; what else they hold is common."""

    def some(name):
        return " ".join(f"{name}{i}" for i in range(50))

    texts = [(1, some("rare") + " " + some("c"), "a"), (2, some("rare") + " " + some("d"), "a")]
    texts += [(texts[0][0], texts[0][1].upper() if again == "upper" else texts[0][1], "a")]
    texts += [(10 + 10 * (c == "d") + i, some(c) + " " + some(f"own{c}{i}x"), "a") for c in "cd" for i in range(6)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    assert rows(jaccard.jaccard_components(df, 3, 90, 100)) == brute_jaccard(texts, 3, 90, 100)
    assert sorted(r["doc_id"] for r in jaccard.keep_one(df, 3, 90, 100).collect()) == sorted({k for k, _, _ in texts})


def test_keep_one(docs, none):
    kept = jaccard.keep_one(docs, k=3, num=90, den=100)
    assert kept.columns == docs.columns
    want = {i for i, _, c in brute_jaccard(TEXTS, 3, 90, 100) if i == c or i is None}
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert jaccard.keep_one(none).count() == 0


def test_components_of_a_long_chain(spark):
    e = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (7, 7)]
    got = {r["v"]: r["component"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500


def brute_dedup(texts, window):
    first = {}
    for key, t, _ in texts:
        w = words(t)
        for i in range(len(w) - window + 1):
            if key is not None:
                g = tuple(w[i : i + window])
                first[g] = min(first.get(g, key), key)
    out = []
    for key, t, _ in texts:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if key is not None and first[tuple(w[i : i + window])] < key:
                gone.update(range(i, i + window))
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((key, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [2, 5, 13])
def test_substring_dedup(docs, window):
    assert rows(substring.substring_dedup(docs, window)) == brute_dedup(TEXTS, window)


@pytest.mark.parametrize("buckets", [1, 7, 1 << 23])
def test_ranges_of_hashes_cover_all_of_them_in_order(buckets):
    hashes = np.sort(np.random.default_rng(0).integers(0, 2**64, 5000, np.uint64, endpoint=False))
    hashes = np.concatenate([np.zeros(1, np.uint64), hashes, np.full(1, 2**64 - 1, np.uint64)])
    found = list(by_range(hashes, buckets))
    assert [x for _, at in found for x in range(at.start, at.stop)] == list(range(len(hashes)))
    of = [b for b, _ in found]
    assert of == sorted(set(of)) and 0 <= of[0] and of[-1] < buckets
    assert list(by_range(hashes[:0], buckets)) == []


def test_cut_repeats_keeps_the_rest_as_it_was(docs, none):
    got = substring.cut_repeats(docs, 13)
    assert got.columns == docs.columns
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[10]["text"] == "é\xa0ß naïve\u2003x " and by[10]["n_chars"] == len(by[10]["text"])
    assert 7 in by and by[12]["text"] == "line\nline\n\nline\n" and 15 not in by and by[0]["text"] is None
    assert substring.cut_repeats(none).count() == 0


def brute_quality(t):
    text = t or ""
    w = text.encode().split()
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.encode().split(b"\n") if x.strip()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_features(docs, none):
    got = quality.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for key, t, _ in TEXTS:
        f = brute_quality(t)
        want.append((key, *f, f[0] < 10 or 100 * f[4] > 20 * f[0]))
    assert rows(got) == sorted(want, key=repr)
    assert quality.quality_rules(none).count() == 0 and quality.keep_good(none).count() == 0


def test_suspect_hosts_only_lose_documents_that_fail_strictly(spark):
    good = " ".join(f"fine{i}" for i in range(50))
    data = [(i, "bad" if i % 2 else "a b", "h1") for i in range(40)] + [(100, good, "h1"), (101, good + " ###########" * 30, "h1"), (102, good, "h2"), (103, good + " ###########" * 30, "h2")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(df).collect()}
    assert (kept[100], kept[101], kept[102], kept[103]) == (True, False, True, False or kept[103])
    assert sorted(r["doc_id"] for r in quality.keep_good(df).collect()) == sorted(i for i, k in kept.items() if k)


def test_token_counts_are_the_library_s(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    got = {r["key" if "key" in r else "doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokens.count_tokens(docs).collect()}
    for key, text, _ in TEXTS:
        assert got[key] == (len((text or "").encode()), len(t.encode(text or "", add_special_tokens=False).ids))
    assert tokens.count_tokens(none).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab é\n\t  \xa0\u3000'0,<|", "<|endoftext|>", "  ", "don't"]), max_size=30).map("".join), min_size=1, max_size=4))
def test_ids_and_counts_of_any_text(texts):
    r, m = tokens.reader(tokens.default_vocabulary()), tokens.merger(tokens.default_vocabulary())
    want = [x.ids for x in r.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in r.read(texts)] == want
    assert m.count(texts) == [len(x) for x in want]


def test_memory_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 8)
    r, m = tokens.IdReader(tokens.default_vocabulary()), tokens.PairMerger(tokens.default_vocabulary())
    for n in range(12):
        texts = [f"some words {n} and word{n} more{n * 7}", "some words again"]
        want = [x.ids for x in r.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in r.read(texts)] == want and m.count(texts) == [len(x) for x in want]


def test_other_vocabularies():
    import public_tokenizers

    m = tokens.merger(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert m.count(["hello world, hello"]) == tokens.merger(tokens.default_vocabulary()).count(["hello world, hello"])
    with pytest.raises(ValueError, match="only"):
        tokens.PairMerger(public_tokenizers.path("piece_bpe_32k.model"))


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    got = packing.pack(docs, capacity=128).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for key, text, _ in TEXTS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by[key], key=lambda r: r["piece"])[:: 2 if key == 6 else 1]
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 128 for r in own[1:])
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 128 and len(at) <= -(-sum(at.values()) // 128) + 2
    assert packing.pack(none).count() == 0


def test_swaps_empty_bins():
    import numpy as np

    rng = np.random.default_rng(0)
    lengths = rng.integers(500, 1300, 3000)
    first = packing.best_fit(lengths, 2048)
    second = packing.swapped([list(b) for b in first], lengths, 2048)
    assert len(second) < len(first)
    assert sorted(i for b in second for i in b) == list(range(3000)) and max(lengths[b].sum() for b in second) <= 2048


def test_language_model(docs, none, spark, sf_dir):
    ids = [k for k, _, _ in TEXTS]
    out = {k: ids[i] is not None and zlib.crc32(str(k).encode()) % 7 == 2 for i, k in enumerate(ids)}
    c = Counter()
    for k, t, _ in TEXTS:
        if not out[k]:
            c.update([*words(t, True), None])
    n, v = sum(c.values()), len(c)
    small = lm.Settings(words=31, classes=32, steps=20, batch=64, noise=16)
    got = {r["doc_id"]: r for r in lm.score_texts(docs, small).collect()}
    for k, t, _ in TEXTS:
        w = [*words(t, True), None]
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[k], len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert math.isfinite(r["score"])
    assert lm.score_texts(none, small).count() == 0
    whole = lm.score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), lm.Settings(words=255, classes=256, steps=300)).where("held_out").toPandas()
    assert whole["score"].sum() > whole["base_score"].sum()


def test_model_is_normalised():
    import numpy as np

    counts = np.random.default_rng(0).integers(0, 5, (20, 20)).astype(np.float32)
    p = lm.log_probabilities(*lm.train(counts, lm.Settings(words=9, classes=10, steps=50, batch=32, noise=8)))
    assert np.allclose((10.0 ** p.astype(np.float64)).sum(axis=1), 1, atol=1e-5)


def test_units_and_training_grow_with_the_corpus(spark):
    rng = np.random.default_rng(0)
    texts = [(i, " ".join(f"w{x}ing" for x in rng.zipf(1.3, 500) % 5000)) for i in range(400)]
    df = spark.createDataFrame(texts, "key long, text string").repartition(3)
    s = lm.Settings(words=50, classes=16, steps=1, batch=256, noise=16, rounds=1)
    counts = Counter(w for _, t in texts for w in t.split())
    found = {}
    for n in (25, 400):
        v = lm.vocabulary(df.where(f"key < {n}"), s)
        found[n] = len(v.words), v.unit_counts().sum()
        assert v.unit_counts().sum() == v.total == 501 * n
    assert found[25][0] > 50 and found[400][0] > 3 * found[25][0]
    assert v.n.sum() >= sum(c for _, c in counts.most_common(2 * math.isqrt(v.total) * 9 // 10)) and v.n.max() == max(counts.values())
    batches = list(lm.in_batches(((np.arange(a, a + 1000), np.arange(a, a + 1000)) for a in (0, 1000)), 2, s, rng))
    assert Counter(np.concatenate([h for h, _ in batches]).tolist()) == dict.fromkeys(range(2000), 2)
    start = lm.fresh(v.unit_counts(), s)
    moved = (lm.trained(df, v, s) != start).any(axis=1)
    assert moved[1 : 1 + len(v.words)].all()
