"""Fingerprints, near duplicates, repeated strings and language identification against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import fingerprints, langid, mixing, neardup, queries, suffixes
from tidewatch.llm.components import components

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "one"), (None, None), (5, "é漢🙂" * 2_000), (6, "a b " * 30_000)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def plain_components(rows, k, percent=80):
    sets, root = {i: shingles(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(n, size, rng, edits):
    """One text and copies of it with some words changed: pairs on both sides of the threshold."""
    base = [f"w{rng.randrange(400)}" for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_components_are_those_of_all_pairs(spark, small_docs, small_texts, k):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(small_docs, k).collect()}
    assert got == plain_components(small_texts, k)


def test_large_groups_in_blocks(spark, documents, monkeypatch):
    """The paths for large leaves and clusters, with limits that a small table exceeds."""
    monkeypatch.setattr(neardup, "LEAF", 30)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(5)
    rows = list(enumerate(near_copies(60, 60, rng, 8) + near_copies(20, 40, rng, 2) + [f"text number {i} alone" for i in range(10)]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(rows), 2).collect()}
    assert got == plain_components(rows, 2)


def test_near_duplicates_of_odd_rows(spark, documents):
    rows = neardup.near_duplicates(documents(ODD), 2).collect()
    assert len(rows) == len(ODD)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows)
    assert got[4, 1, 4, True] == 2 and got[None, 1, 4, False] == 1 and got[None, 0, None, True] == 1
    assert got[1, 0, 1, True] == got[2, 0, 2, True] == got[3, 0, 3, True] == 1
    assert neardup.near_duplicates(documents([]), 2).count() == 0
    kept = neardup.one_of_each(documents(ODD), 2)
    assert kept.columns == documents([]).columns and kept.filter("doc_id = 5").count() == 1


@pytest.mark.parametrize("k", [2, 5])
def test_rows_with_a_common_id_are_one_document(spark, documents, k):
    a, b, c = ("a b c d e f g", "h i j k l m n", "o p q r s t u")
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (9, None), (9, c), (None, c), (None, "x y"), (None, "x y"), (None, "x  Y")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(documents(rows), k).collect())
    n = 8 - k
    assert got[3, n, 3, True] == 1 and got[5, n, 3, False] == 2 and got[7, n, 3, False] == 1
    assert got[8, n, 8, True] == 1 and got[9, n, 8, False] == got[9, 0, 8, False] == got[None, n, 8, False] == 1
    assert got[None, 1, None, True] in (1, 2) and got[None, 1, None, True] + got[None, 1, None, False] == 3


def test_any_names_of_other_columns(spark):
    """Columns that are named as helpers of the stages are."""
    names = ["doc_id", "text", "lang", "source", "n_chars", "kept_id", "KEPT_CLASS", "class", "drawn_parts", "row", "n", "tag", "rank", "span", "node", "copy", "parts"]
    rows = [(i, f"some words of number {i} and of no other " * 30, "en", "s", 9, *([1] * 12)) for i in range(9)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n in ('text', 'lang', 'source') else 'long'}" for n in names))
    assert neardup.one_of_each(docs).columns == suffixes.strip(docs).columns == names
    assert neardup.one_of_each(docs).count() == suffixes.strip(docs).count() == 9
    mixed = mixing.mix(docs)
    assert mixed.columns == names and mixed.count() > 0


def test_many_rows_without_an_id_are_told_apart(spark, documents):
    """As many strangers as once shared some bits of a hash with planted pairs."""
    rng = random.Random(8)
    pairs = ["".join(rng.choice("abcdefgh ") for _ in range(500)) for _ in range(300)]
    clean = ["".join(rng.choice("abcdefgh ") for _ in range(500)) for _ in range(6_000)]
    rows = [(None, f"{t}{i}") for i, t in enumerate(pairs + pairs)] + [(None, t) for t in clean]
    got = Counter(r.n_removed for r in suffixes.remove_repeats(documents(rows)).select("n_removed").collect())
    assert got == {0: 6_000, 500: 600} or got[0] == 6_000 and sum(got.values()) == 6_600


def test_repeated_rows_are_removed_alike(spark, documents):
    text = "".join(random.Random(9).choice("abcdefgh ") for _ in range(900))
    got = [(r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(documents([(None, text)] * 40 + [(1, text[:300])])).collect()]
    assert sorted(got) == [(300, 0, 0)] + [(900, 900, 1)] * 40


def test_words_alike_by_construction_are_not_linked(spark, documents):
    """A sequence and its complement have the same polynomial hash modulo a power of two, whatever its base."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1_024))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, other), (3, one.upper()), (4, " ".join(one)), (5, " ".join(other))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(rows), 2).collect()}
    assert got == plain_components(rows, 2)
    left = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(documents([(1, "x" + one[:512] + "y"), (2, "z" + other[:512])])).collect()}
    plain = plain_repeats([b"x" + one[:512].encode() + b"y", b"z" + other[:512].encode()], 400)
    assert left == {1: plain[0][1], 2: plain[1][1]}


def test_clusters_in_blocks_by_shingles(spark, documents, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 200)
    rows = list(enumerate(near_copies(25, 60, random.Random(6), 8)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(rows), 2).collect()}
    assert got == plain_components(rows, 2)


def test_recall_of_the_trees():
    """Pairs at the threshold share a leaf but for one in a thousand or so."""
    rng, missed = np.random.default_rng(1), 0
    for _ in range(300):
        common = rng.integers(0, 2**63, 800, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, 100, dtype=np.uint64)])) for _ in range(2))
        sig = np.stack([neardup.signature(a), neardup.signature(b)])
        roots = neardup.mix64(np.arange(1, neardup.TREES + 1, dtype=np.uint64))
        node, row = neardup._branch(sig, np.repeat(roots, 2), np.tile(np.arange(2), neardup.TREES), neardup.LEVELS)
        missed += not set(node[row == 0]) & set(node[row == 1])
    assert missed <= 2


def test_recall_in_large_leaves(spark, documents, monkeypatch):
    """Leaves over the limit lose no more pairs than others: pairs near the threshold, in leaves filled by others too short or too long for a link."""
    monkeypatch.setattr(neardup, "LEAF", 2)
    rows = []
    for p in range(100):
        common, own = [f"p{p}n{i}" for i in range(550)], [[f"p{p}s{side}n{i}" for i in range(66)] for side in range(2)]
        short, long = common[:470], common + own[0] + own[1] + [f"p{p}more{i}" for i in range(100)]
        rows += [" ".join(words) for words in (common + own[0], common + own[1], short, short[1:], long, long[1:])]
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(list(enumerate(rows))), 1).collect()}
    assert all(c in (i, i - i % 2) for i, c in found.items())
    assert sum(found[6 * p + 1] != 6 * p for p in range(100)) <= 1


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 300), (2, 1)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 140)} | {300: 300}


def plain_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("many, length", [(1_024, 400), (1, 400), (1_024, 256), (1, 100), (1_024, 511)])
def test_repeated_strings_are_those_of_all_strings(spark, documents, monkeypatch, many, length):
    """Both ways of deciding single strings; borders at any byte, repeats in one text, overlaps, runs of one letter."""
    monkeypatch.setattr(suffixes, "MANY", many)
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    long, other = noise(1_500), noise(450)
    texts = [noise(50) + long + noise(300), long[200:900] + noise(10), noise(700) + other + noise(3), other[3:], other[:399], "x" * 900, noise(20) + long[1000:1450] + noise(5) + long[1000:1401], noise(800), long, long]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(documents(rows), length=length).collect()}
    assert got == dict(enumerate(plain_repeats([t.encode() for t in texts], length)))


def test_repeated_strings_of_small_table(spark, small_docs, small_texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(small_docs, "kept_sha256").collect()}
    want = plain_repeats([t.encode() for _, t in small_texts], 400)
    assert got == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for (i, _), w in zip(small_texts, want)}


def test_repeated_strings_query_shows_what_is_left(spark, tmp_path):
    """The digest, the counts and the remaining text, for a long passage of two documents, a cut inside a character, and a clean text."""
    passage = "".join(random.Random(3).choices("abcdefgh ", k=500))
    texts = ["before " + passage + " after", "é" + passage + "è", "nothing of it", None, "x" * 399 + "é" + "y" + "x" * 399 + "è" + "y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op6_repeated_strings(spark, str(tmp_path))
    assert rows.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    want = plain_repeats([(t or "").encode() for t in texts], 400)
    assert {r.doc_id: tuple(r)[1:] for r in rows.collect()} == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest(), w[3].decode("utf-8", "ignore")) for i, w in enumerate(want)}
    assert want[0][1] == 500 and want[4][3] == "é".encode()[1:] + b"y" + "è".encode()[1:] + b"y"


def test_repeated_strings_of_odd_rows(spark, documents):
    rows = suffixes.remove_repeats(documents([*ODD, (5, "b" * 500), (None, "c" * 300)])).collect()
    assert len(rows) == len(ODD) + 2
    assert {r.n_bytes: r.n_removed for r in rows if r.doc_id in (1, 2, 4)} == {0: 0, 3: 0}
    assert [r.n_removed for r in rows if r.doc_id == 6] == [120_000]
    stripped = suffixes.strip(documents([(1, "é" * 300), (2, "é" * 300), (3, "clean")]))
    assert stripped.columns == documents([]).columns
    assert {(r.doc_id, r.text, r.n_chars) for r in stripped.collect()} == {(1, "", 0), (2, "", 0), (3, "clean", 5)}
    assert suffixes.remove_repeats(documents([])).count() == 0


def test_chunks_resist_shifts():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(20_000)).encode()
    a, b = fingerprints.chunk_texts([text, b"inserted" + text])
    assert fingerprints.containment(a, b) > 0.98
    assert fingerprints.chunk_texts([b"zz" * 40, text]) [1] == a
    assert fingerprints.from_string(fingerprints.to_string(a)) == a
    assert fingerprints.containment({}, {}) == 1 and fingerprints.containment(a, {}) == 0
    assert sum(fingerprints.chunk_texts([b"q" * 10_000])[0].values()) <= 10_000


def plain_chunks(data):
    """Byte by byte: digest and length of each chunk."""
    out, start = {}, 0
    while start < len(data):
        for i in range(start, len(data)):
            n = i - start + 1
            if n < 32:
                continue
            h = sum(int(fingerprints.GEAR[data[i - k]]) << k for k in range(32)) & 0xFFFFFFFF
            if n == 256 or not h >> (25 if n < 64 else 27):
                break
        out[xxhash.xxh3_64_hexdigest(data[start : i + 1])] = i + 1 - start
        start = i + 1
    return out


def plain_likeness(a, b):
    least = min(sum(a.values()), sum(b.values()))
    return sum(n for d, n in a.items() if d in b) / least if least else float(not a and not b)


def test_fingerprints_are_those_of_a_plain_chunker(spark, documents):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh é漢") for _ in range(n)) for n in (0, 1, 31, 33, 400, 2_500)] + ["z" * 700, None]
    texts.append((texts[5][:900] + "new" + texts[5][900:])[::1])
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprints.edit_likeness(documents(rows)).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, changed, following = (plain_chunks(x.encode()) for x in (t, edited, after))
        assert fingerprints.from_string(got[i].fingerprint) == own and fingerprints.from_string(got[i].edited_fingerprint) == changed
        assert (got[i].near_edited, got[i].near_next) == pytest.approx((plain_likeness(own, changed), plain_likeness(own, following)))


def test_edits_meet_the_next_document(spark, documents):
    rows = [(i, t) for i, t in ODD if i is not None and i not in (4, 6)] + [(9, "nine" * 100), (12, "twelve" * 300), (15, None)]
    rows.sort()
    got = {r.doc_id: r for r in fingerprints.edit_likeness(documents(rows)).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        cut = len(t) // 2
        want = t[: len(t) - cut] + after[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[i].edited_fingerprint == fingerprints.to_string(fingerprints.chunk_texts([want.encode()])[0])
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert fingerprints.edit_likeness(documents([])).count() == 0
    assert fingerprints.edit_likeness(documents(ODD)).count() == len(ODD)


def test_fingerprints_tell_edits_from_strangers(spark, small_docs):
    rows = fingerprints.edit_likeness(small_docs).collect()
    assert np.mean([r.near_edited for r in rows]) > 0.4 and np.mean([r.near_next for r in rows]) < 0.1


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.filter(~langid.held_out()))
    rows = langid.predict(docs, model).join(docs.filter(langid.held_out()).select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 250 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def plain_language(train, text, min_share=2e-5):
    """By sets of n-grams, without filters: part of each language."""
    grams = lambda t: [g for g in (lambda b: [b[i : i + 4] for i in range(len(b) - 3)])(bytes(c if c > 127 or chr(c).isalpha() else 32 for c in f" {t.lower()} ".encode()) + b"   ") if g[1] != 32 and g[2] != 32]
    if train:
        counts = {}
        for t, lang in train:
            counts.setdefault(lang, Counter()).update(grams(t))
        return {lang: {g for g, n in c.items() if n >= min_share * sum(c.values())} for lang, c in counts.items()}
    return grams(text)


def test_language_is_that_of_plain_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 400")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect() if r.text and r.lang]
    sets = plain_language([(t, lang) for _, t, lang in rows], "")
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(docs)).collect()}
    same = 0
    for i, t, _ in rows:
        grams = plain_language(None, t)
        share = {lang: sum(g in known for g in grams) / max(len(grams), 1) for lang, known in sets.items()}
        best = min(share, key=lambda x: (-share[x], x))
        same += best == got[i].lang_pred
        if sum(share.values()):
            assert got[i].score == pytest.approx(max(share.values()) / sum(share.values()), abs=0.02)
    assert same >= 0.99 * len(rows)


def test_very_long_texts(spark, documents):
    """Longer than any slice, alone and twice."""
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "short text of a few words")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(rows), 2).collect()}
    assert got == plain_components(rows, 2)
    removed = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(documents(rows)).collect()}
    assert removed == {1: (len(long), len(long)), 2: (len(long) + 4, len(long)), 3: (25, 0)}
    model = langid.train(documents([(1, "the text of it"), (2, "der text davon")]).withColumn("lang", F.when(F.col("doc_id") == 1, "en").otherwise("de")))
    assert langid.predict(documents([(1, "the text of it " * 200_000)]), model).first().lang_pred == "en"


def test_language_of_odd_rows(spark, documents, small_docs):
    model = langid.train(small_docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(documents([*ODD, (8, "12 + 3 !?")]), model).collect()}
    assert got[1] == got[2] == got[3] == got[8] == ("und", 0.0)
    assert got[5][0] in model.languages  # letters of no language that was learned
    assert langid.predict(documents([]), model).count() == 0
    none = langid.train(documents([(1, "text")]))
    assert langid.predict(documents([(1, "text")]), none).first().lang_pred == "und"
    accepted = langid.accept(documents(ODD), model)
    assert accepted.columns == documents([]).columns and {r.doc_id for r in accepted.collect()} == {4, 5, 6, None}


def test_bloom_rows_give_all_languages():
    code = np.arange(3_000, dtype=np.uint32)
    rows = np.zeros(1 << 16, np.uint8)
    for bit, own in enumerate((code[:2_000], code[1_000:])):
        for p in langid.positions(own, len(rows)):
            rows[p] |= np.uint8(1 << bit)
    mask = np.full(len(code), 255, np.uint8)
    for p in langid.positions(code, len(rows)):
        mask &= rows[p]
    assert (mask[:2_000] & 1).all() and (mask[1_000:] & 2).all() and np.mean(mask[:1_000] & 2 > 0) < 0.01
