"""Tokens and mixing: the BPE transducer, Simple-8b files, and shares of sources."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import bpe, mixing, pretokens, simple8b

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY_ITSELF = Tokenizer.from_file(LIBRARY)
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "it's we'll 'sand don't!'s  x"), (4, "it's we'll 'sand don't!'s  x"), (None, "none"), (5, "é漢🙂\x00\x1c " * 500), (6, "aaaa" * 5_000), (7, "x <|endoftext|><|endoftext|> y"), (8, "<|endoftext|>")]
#: A sequence and its complement, which have the same polynomial hash modulo a power of two whatever its base.
MORSE = "".join("ab"[i.bit_count() % 2] for i in range(1_024))
COMPLEMENT = MORSE.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])) | st.lists(st.sampled_from(["a", "é", " ", "  ", "\n", "'s", "'re", "'", "1", "²", "!", "漢", "the ", "\xa0", "ing", "\x00"])).map("".join), max_size=5))
def test_ids_are_those_of_the_library(reference, texts):
    ids, counts = bpe.codec(RANKS)[0].encode_texts(texts)
    assert counts.tolist() == [len(reference.encode_ordinary(t)) for t in texts]
    assert ids.tolist() == [i for t in texts for i in reference.encode_ordinary(t)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])) | st.lists(st.sampled_from(["a", "é", " ", "  ", "\n", "\r\n", "'s", "'re", "'", "1", "²", "!", "漢", "the ", "\xa0", "ing", "\x00", "\x1c", "\x85", "<|endoftext|>"])).map("".join), max_size=5))
def test_library_ids_piece_by_piece(texts):
    want = [LIBRARY_ITSELF.encode(t, add_special_tokens=False).ids for t in texts]
    ids, counts = simple8b.library_codec(LIBRARY).encode_texts(texts)
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [*map(len, want)]


def test_round_trip(spark, documents, small_texts, reference):
    rows = small_texts + [(i, t) for i, t in ODD if i is None]
    for r in bpe.round_trip(documents(rows), RANKS).collect():
        text = dict(rows)[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_odd_rows_encode_and_decode(spark, documents):
    docs = documents(ODD)
    back = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in ODD)
    assert bpe.encode(documents([]), RANKS).count() == 0


def test_small_limits_change_nothing(reference):
    machine = bpe.Transducer(bpe.read_ranks(RANKS), limit=50)
    cached = pretokens.PieceCache(lambda pieces: [machine.encode_piece(p.encode()) for p in pieces], limit=4)
    for text in ("unbelievable internationalisation of tokenisers", "Donaudampfschifffahrtsgesellschaft und so weiter") * 2:
        assert cached.encode_texts([text])[0].tolist() == reference.encode_ordinary(text)


def test_pieces_are_told_apart_by_their_bytes(reference, monkeypatch):
    texts = [MORSE + "\n" + COMPLEMENT, COMPLEMENT, "hello <|endoftext|> world", "", "\x00 \x00\x00"]
    library = Tokenizer.from_file(LIBRARY)
    for weak in (False, True):
        if weak:  # nearly all pieces have the hash of others
            monkeypatch.setattr(pretokens, "span_hashes", lambda words, size: size.astype(np.uint64) % np.uint64(3))
        ids, _ = pretokens.PieceCache(bpe.codec(RANKS)[0].encode).encode_texts(texts)
        assert ids.tolist() == [i for t in texts for i in reference.encode_ordinary(t)]
        for special in (False, True):
            library.encode_special_tokens = special
            ids, counts = simple8b.LibraryCodec(LIBRARY, special_as_text=special).encode_texts(texts)
            want = [library.encode(t, add_special_tokens=False).ids for t in texts]
            assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [*map(len, want)]


def test_long_texts_go_in_parts(reference, monkeypatch):
    monkeypatch.setattr(pretokens, "SLICE_CHARS", 20)
    texts = ["it's   a\n\n long text, isn't it?  And\x1c\u2003 so on " * 20, "short", "x" * 500 + " y" * 50]
    ids, counts = pretokens.PieceCache(bpe.codec(RANKS)[0].encode).encode_texts(texts)
    want = [reference.encode_ordinary(t) for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [*map(len, want)]


@given(st.binary(max_size=40), st.lists(st.integers(0, 40)))
def test_utf8_stream(data, cuts):
    stream, out, at = bpe.Utf8Stream(), [], 0
    for c in sorted(cuts):
        out.append(stream.feed(data[at:c]))
        at = max(at, c)
    out += [stream.feed(data[at:]), stream.feed(b"", last=True)]
    valid = data.decode("utf-8", "ignore").encode() == data
    assert "".join(out) == data.decode("utf-8", "replace") or not valid


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 3) | st.integers(0, 50_000), max_size=400) | st.integers(0, 600).map(lambda n: [0] * n))
def test_simple8b(ids):
    x = np.array(ids, np.uint64)
    words, first = simple8b.pack(x)
    assert np.array_equal(simple8b.unpack(words, first, len(x)), x)
    assert len(words) <= len(x) + sum(i >= 2**60 for i in ids)


@pytest.mark.parametrize("odd", [False, True])
def test_files_hold_the_library_ids(spark, documents, small_texts, tmp_path, odd):
    rows = ODD if odd else small_texts
    simple8b.write(documents(rows), LIBRARY, str(tmp_path / "out"))
    got = simple8b.with_starts(simple8b.read(spark, str(tmp_path / "out"))).orderBy("start").collect()
    library = Tokenizer.from_file(LIBRARY)
    at = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(ids), ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_empty_table_in_files(spark, documents, tmp_path):
    simple8b.write(documents([]), LIBRARY, str(tmp_path / "out"))
    assert simple8b.with_starts(simple8b.read(spark, str(tmp_path / "out"))).count() == 0


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([10, 0, 10], [5, 2, 1], 40) == [20, 0, 20]
    assert sum(mixing.targets([7, 900, 30, 2], [5, 2, 1, 5], 1_408)) == pytest.approx(1_408)


def test_draws_fill_the_slots():
    slots, got = [700, 0, 120, 3], defaultdict(list)
    per_shard = defaultdict(int)
    for shard, source, first, n in mixing.draw(slots, 16, 1):
        got[source] += range(first, first + n)
        per_shard[shard] += n
    assert all(got[i] == list(range(n)) for i, n in enumerate(slots))
    assert max(per_shard.values()) - min(per_shard.values()) <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1_000])
def test_permutation(n):
    for key in (0, 9):
        assert sorted(mixing.permute(np.arange(n), np.full(n, n), np.full(n, key, np.uint64)).tolist()) == list(range(n))


def test_mix_of_small_table(spark, small_docs):
    docs = small_docs.unionByName(spark.createDataFrame([(10_000, None, None, None, 0), (10_001, "a b c " * 900, None, None, 0), (10_002, "", None, "src0", 0)], small_docs.schema))
    rows = mixing.taken_words(docs).collect()
    again = mixing.taken_words(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == docs.count()
    text = {r.doc_id: r for r in docs.collect()}
    by = defaultdict(lambda: [0, 0, None, None])
    for r in rows:
        d = text[r.doc_id]
        assert r.size == len((d.text or "").split()) and 0 <= r.taken <= 2 * r.size
        by[d.source][0] += r.size
        by[d.source][1] += r.taken
        by[d.source][2:] = [r.source_size, r.target]
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = mixing.targets([by[s][0] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(v[0] for v in by.values()))
    for s, t in zip(names, want):
        assert by[s][2] == by[s][0] and by[s][3] == pytest.approx(t) and abs(by[s][1] - t) <= 2 * mixing.BLOCK


def test_mix_is_that_of_plain_slots(spark, small_docs):
    """Documents tile their source's row of words; what is taken follows slot by slot from the draws and permutations."""
    docs = small_docs.unionByName(small_docs.filter("doc_id < 20")).unionByName(spark.createDataFrame([(None, f"a b c {i}", None, "src1", 0) for i in range(50)] + [(None, "same", None, "src1", 0)] * 30, small_docs.schema))
    rows = mixing.numbered(docs, ["doc_id"])
    placed, figures = mixing.place(rows, (5, 2, 1), 1.5)
    at = defaultdict(list)
    for r in placed.collect():
        at[r.number].append((r.place, r.size, r.n))
    taken = defaultdict(int)
    for f in figures.itertuples():
        row = sorted(x for x in at[f.number] if x[1])
        assert [p for p, _, _ in row] == [0, *np.cumsum([n for _, n, _ in row]).tolist()][:-1] and sum(n for _, n, _ in row) == f.words
        slots = np.concatenate([np.arange(first, first + n) for _, source, first, n in mixing.draw(figures["slots"].tolist(), mixing.SHARDS, 1) if source == f.number] or [np.zeros(0, int)])
        assert sorted(slots.tolist()) == list(range(f.slots))
        blocks = f.blocks
        for slot in slots.tolist():
            key = mixing.mix64(np.uint64(1) + mixing.mix64(np.array([f.number << 32 | slot // blocks], np.uint64)))
            block = int(mixing.permute(np.array([slot % blocks]), np.array([blocks]), key)[0])
            for p, n, i in row:
                taken[i] += max(0, min(p + n, (block + 1) * mixing.BLOCK) - max(p, block * mixing.BLOCK))
    want = sorted((str(r.doc_id), r.size, taken[r.n]) for r in rows.collect())
    assert want == sorted((str(r.doc_id), r.size, r.taken) for r in mixing.taken_words(docs).collect())


def test_mix_gives_the_words_taken(spark, small_docs):
    mixed = mixing.mix(small_docs)
    assert mixed.columns == small_docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert dict(words) == {r.doc_id: r.taken for r in mixing.taken_words(small_docs).collect() if r.taken}


def test_mix_of_nothing(spark, documents):
    assert mixing.taken_words(documents([])).count() == 0 and mixing.mix(documents([])).count() == 0
    assert mixing.taken_words(documents([(1, None), (2, "")])).count() == 2


def test_join_words():
    assert mixing.join_words(" a  b\tc d e ", [(0, 1), (1, 3), (4, 5)]) == "a  b\tc\ne"


def test_letters_of_newer_unicode_are_as_the_library_has_them(reference):
    odd = np.flatnonzero(pretokens.char_classes() != pretokens.char_classes(pretokens.matched_by_regex)).tolist()
    texts = [f"a{chr(c)}a {chr(c)}1 {chr(c)}" for c in [0x18DA7, 0x10EE7, 0x16EA7, *odd[::150]]]
    ids, counts = bpe.codec(RANKS)[0].encode_texts(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [reference.encode_ordinary(t) for t in texts]


def test_states_are_bounded_inside_one_piece(reference):
    machine = bpe.Transducer(bpe.read_ranks(RANKS), limit=200)
    text = "".join(random.Random(5).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    assert machine.encode_piece(text.encode()) == reference.encode_ordinary(text)
    assert len(machine.moves) <= 202 and len(machine.states) <= 300


def test_invented_words_cost_little(reference, monkeypatch):
    """Two tokens are judged once, whatever states they meet in, also after states were dropped; and few states are dropped for new words."""
    judged, fit = [], bpe.Transducer._fit
    monkeypatch.setattr(bpe.Transducer, "_fit", lambda self, a, b: judged.append((a, b)) or fit(self, a, b))
    r = random.Random(7)
    syllables = "an the ción èr queß lich ñ ou eau zu ting ble ä tre".split()
    words = [" " + "".join(r.choices(syllables, k=r.randint(2, 6))) for _ in range(6_000)]
    for limit in (4_000, None):
        machine = bpe.Transducer(bpe.read_ranks(RANKS), **({"limit": limit} if limit else {}))
        judged.clear()
        assert [machine.encode_piece(w.encode()) for w in words] == [reference.encode_ordinary(w) for w in words]
        assert len(judged) == len(set(judged)) > 0
    assert len(machine.moves) < 0.5 * sum(len(w.encode()) for w in words)


def test_files_of_ids_are_bounded_in_blocks(spark, documents, monkeypatch, tmp_path):
    monkeypatch.setattr(simple8b, "FILE_BLOCKS", 2)
    texts = [(i % 7 if i % 5 else None, f"text number {i} " * 9) for i in range(60)]
    simple8b.write(documents(texts), LIBRARY, str(tmp_path / "ids"), block_ids=64)
    rows = simple8b.with_starts(simple8b.read(spark, str(tmp_path / "ids"))).orderBy("start").collect()
    assert len(list((tmp_path / "ids").glob("part-*"))) > 20 and len(rows) == 60
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
