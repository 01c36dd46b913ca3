"""The Jaccard join by PartEnum signatures against all pairs, and its guarantee that partners share a signature."""

import random

import numpy as np
import pytest

from tests.llm.test_graphs import in_order
from tests.llm.test_text import near_copies, plain_components, shingles
from tidewatch.llm import partenum

NAMES = "doc_id long, text string, class long, n long, node long, cluster long, own int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 3, 4, 5, 6, 7, 8) for r in rows], NAMES)


def test_components_of_the_given_documents(spark, small_docs, small_texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.join(small_docs).collect()}
    assert got == plain_components(small_texts, 5)


@pytest.mark.parametrize("group, block", [(8_192, 1_024), (8, 4)])
def test_near_copies_of_all_sizes_and_in_blocks(spark, monkeypatch, group, block):
    rng = random.Random(group)
    texts = [t for size in (5, 6, 9, 12, 30, 80, 300) for t in near_copies(9, size, rng, max(2, size // 9))]
    texts += near_copies(60, 100, rng, 4) + ["one", "One", "two three", "two  three", "a b c d", "A b c\td"]
    monkeypatch.setattr(partenum, "GROUP", group)
    monkeypatch.setattr(partenum, "BLOCK", block)
    monkeypatch.setattr(partenum, "BUCKETS", 2)
    monkeypatch.setattr(partenum, "SEEN", 20)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.join(table(spark, rows)).collect()}
    assert got == plain_components(rows, 5)


def test_rows_with_a_common_id_are_one_document(spark):
    a, b, c = ("a b c d e f g", "h i j k l m n", "o p q r s t u")
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (8, c), (9, None), (9, c), (10, ""), (None, c), (None, None), (11, " \n"), (None, "x y"), (12, "é" * 300_000)]
    got = in_order(partenum.join(table(spark, rows)).collect())
    want = [(i, len(shingles(t, 5)), {5: 3, 7: 3, 9: 8}.get(i, 8 if t == c else i)) for i, t in rows]
    assert got == in_order(want)


def test_a_bridge_without_an_id_links(spark):
    words = [f"w{i}" for i in range(104)]
    rows = [(1, " ".join(words)), (None, " ".join(words[:92])), (3, " ".join(words[:80]))]
    sets = [shingles(t, 5) for _, t in rows]
    assert len(sets[0] & sets[2]) < 0.8 * len(sets[0] | sets[2])
    assert [r.component_id for r in partenum.join(table(spark, rows)).collect()] == [1, 1, 1]


def test_no_documents_give_no_rows(spark):
    got = partenum.join(table(spark, []))
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.collect() == []


@pytest.mark.parametrize("percent", [80, 70, 95])
def test_partners_always_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    partners = 0
    for _ in range(1_500):
        n = int(rng.choice([1, 2, 4, 5, 6, 8, 9, 10, 13, 17, 20, 33, 64, 100, 300, 900]))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        drop, more = rng.integers(0, n // 4 + 1, 2)
        b = np.unique(np.concatenate([rng.permutation(a)[: len(a) - drop], rng.integers(0, 2**64, more, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not both or 100 * both < percent * (len(a) + len(b) - both):
            continue
        owner, upper, sig = partenum.signed([a, b], percent)
        lower = set(sig[upper == 0].tolist())
        partners += 1
        assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist()) & lower
    assert partners > 200
