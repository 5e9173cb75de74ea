"""Near copies: the groups are those of all similar pairs, not only of the pairs that a forest verifies."""

import random

import pytest
from test_corpus_pipeline import first_of_groups, shingles, similar_pairs

from larkspur.llm import simhash


def copies_of(rnd: random.Random, n_bases: int, n_copies: int, n_words: int) -> dict[int, str]:
    """Texts that differ from a base in up to a tenth of their words or of their length, so that
    many pairs are about as similar as is asked for."""
    texts = {}
    for _ in range(n_bases):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(6, n_words))]
        for _ in range(n_copies):
            words = list(base)
            for _ in range(rnd.randint(0, 1 + len(words) // 50)):
                words[rnd.randrange(len(words))] = f"w{rnd.randrange(3000)}"
            texts[len(texts)] = " ".join(words[: len(words) - rnd.randint(0, len(words) // 10)])
    order = list(range(len(texts)))
    rnd.shuffle(order)
    return {k: texts[i] for i, k in enumerate(order)}


@pytest.mark.parametrize("limit", [3, simhash.LIST_LIMIT])
def test_groups_are_those_of_all_similar_pairs(spark, limit):
    texts = copies_of(random.Random(11), 40, 16, 150) | {10_000: "", 10_001: "one", 10_002: "One ", 10_003: "one two"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in simhash.keep_one_copy(docs, limit).collect()}
    assert kept == first_of_groups(texts)
    assert len(kept) < len(texts) / 2


def test_real_texts_and_their_edited_copies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    texts, rnd = {r.doc_id: r.text for r in docs.collect()}, random.Random(6)
    for k in range(0, 400, 2):
        words = texts[k].split()
        for _ in range(max(1, len(words) // 50)):
            words[rnd.randrange(len(words))] = "other"
        texts[10_000 + k] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one_copy(docs).collect()} == first_of_groups(texts)


@pytest.mark.parametrize("limit", [4, simhash.LIST_LIMIT])
def test_first_shingles_meet_for_all_similar_pairs(spark, limit):
    """Whatever the order, without any link known."""
    texts = copies_of(random.Random(12), 12, 12, 80)
    texts = {k: t for k, t in texts.items() if t not in {texts[i] for i in range(k)}}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    blocks = simhash.shingle_sets([t.encode() for t in texts.values()])
    sets = [{h for o, h in zip(*map(list, blocks)) if o == i} for i in range(len(texts))]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts.values()]
    of = {simhash.xxhash.xxh64_intdigest(t.encode()): k for k, t in texts.items()}
    signed = {k: h - (1 << 64) if h >> 63 else h for h, k in of.items()}
    marks = simhash._signatures(*blocks, len(texts))
    nodes = spark.createDataFrame([(signed[k], bytearray(m)) for k, m in zip(texts, marks)], "norm long, signature binary")
    labels = spark.createDataFrame([], "norm long, label long")
    of = {n: k for k, n in signed.items()}
    for counts in (simhash.np.zeros(simhash.COUNTERS, int), simhash.np.arange(simhash.COUNTERS) * 7919 % 1009):
        found = {frozenset((of[r.u], of[r.v])) for r in simhash.remaining_pairs(docs, nodes, labels, counts, limit).collect()}
        assert {frozenset(p) for p in similar_pairs(texts)} <= found
