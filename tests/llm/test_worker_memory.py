"""What workers hold: small pieces at a time, and nothing of another function's tasks."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from larkspur.llm import bpe, secrets
from larkspur.llm.common import map_arrow


def test_tokens_are_counted_a_few_at_a_time(spark):
    rnd = random.Random(5)
    words = [f"w{rnd.randrange(10**9)}" for _ in range(40_000)]
    docs = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
    rows = [pa.RecordBatch.from_pydict({"text": docs})]
    made = []

    class Frame:  # runs the function here, where its memory can be seen
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, fn, _):
            made.append(fn)

    secrets.corpus_counts(Frame())
    tracemalloc.start()
    (counted,) = made[0](iter(rows))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    expected = Counter()
    for word in words:
        for form in secrets.joined_identifiers(word):
            expected.update((0, a, b) for a, b in secrets.transitions(form).elements())
    found = {(r["label"], r["a"], r["b"]): r["n"] for r in counted.to_pylist()}
    assert found == expected
    assert peak < 25e6, peak


def test_workers_drop_what_another_function_kept(spark):
    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(8)], "doc_id long, text string").repartition(4)
    assert bpe.encode_documents(docs).count() == 8

    def held(batches):
        for batch in batches:
            n = bpe.codec_of.cache_info().currsize + bpe.vocabulary_of.cache_info().currsize
            yield pa.RecordBatch.from_pydict({"n": pa.array(np.full(batch.num_rows, n))})

    assert {r.n for r in map_arrow(docs, held, "n long").collect()} == {0}
