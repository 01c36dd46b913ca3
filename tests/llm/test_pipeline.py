"""The pipeline's stages one by one, on a small table with planted cases."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_text import plain_components, plain_repeats
from tidewatch.llm import bpe, mixing


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = docs.filter("doc_id = 1").first()
    planted = [(9_000, first.text, "en", "src1", 0), (9_001, first.text + " more", None, "src1", 0), (9_002, None, None, None, None), (9_003, "12 34", "en", "src0", 5)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(spark.createDataFrame(stage(spark, out[-1], "/root/testdata/sf0.001").collect(), stage(spark, out[-1], "").schema))
    return out


def test_columns_stay(stages):
    assert all(t.columns == stages[0].columns for t in stages[:-1])


def test_rejected_documents_go_and_clean_ones_stay(stages):
    before, after = ({r.doc_id for r in t.collect()} for t in stages[:2])
    assert before - after == {9_002, 9_003}
    assert {r.lang for r in stages[1].collect()} <= {"en", "de", "fr", "es"}


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert {r.doc_id for r in stages[2].collect()} == {i for i, (_, c) in plain_components(rows, 5).items() if i == c}


def test_no_long_string_is_left_twice(stages):
    assert {r.doc_id for r in stages[3].collect()} == {r.doc_id for r in stages[2].collect()}
    texts, rng = [r.text.encode() for r in stages[3].collect()], random.Random(1)
    joined = b"\x00".join(texts)
    for t in texts:
        for _ in range(5 * (len(t) >= 800)):
            i = rng.randrange(len(t) - 799)
            assert joined.count(t[i : i + 800]) == 1


def test_texts_are_those_of_plain_removal(stages):
    before = [(r.doc_id, r.text) for r in stages[2].collect()]
    left = {i: w[3].decode("utf-8", "ignore") for (i, _), w in zip(before, plain_repeats([t.encode() for _, t in before], corpus_pipeline.PASSAGE_BYTES))}
    assert {r.doc_id: r.text for r in stages[3].collect()} == left


def test_the_mix_takes_words_by_target(stages):
    """Words of each document are those that the operator says it takes, in their order, and sources come near their targets."""
    texts = {r.doc_id: (r.text.split(), r.source) for r in stages[3].collect()}
    words, mixed = Counter(), stages[4].collect()
    for r in mixed:
        words[r.doc_id] += len(r.text.split())
        assert not Counter(r.text.split()) - Counter(texts[r.doc_id][0]) and r.n_chars == len(r.text)
    assert words == {r.doc_id: r.taken for r in mixing.taken_words(stages[3]).collect() if r.taken}
    sizes, weights = Counter(), (5, 2, 1)
    for own, source in texts.values():
        sizes[source] += len(own)
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    target = dict(zip(names, mixing.targets([sizes[x] for x in names], [weights[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()))))
    got = Counter()
    for i, n in words.items():
        got[texts[i][1]] += n
    assert all(abs(got[x] - target[x]) <= 2 * mixing.BLOCK for x in names) and all(n <= 2 * len(texts[i][0]) for i, n in words.items())


def test_tokens_are_those_of_the_library(stages):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((r.doc_id, library.encode_ordinary(r.text), sha(r.text)) for r in stages[4].collect())
    assert sorted((r.doc_id, r.ids, r.decoded_sha256) for r in stages[5].collect()) == want


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_an_empty_table(spark, stages, name, stage):
    empty = stages[0].limit(0)
    out = stage(spark, empty, "")
    assert out.count() == 0 and (out.columns == empty.columns or name == corpus_pipeline.STAGES[-1][0])
