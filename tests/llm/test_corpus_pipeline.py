"""The pipeline's stages, and its rows against a plain version of each stage."""

import random
from collections import Counter
from itertools import combinations

from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from larkspur.llm import bpe, decontaminate, secrets, simhash, toxicity


def shingles(text: str) -> set:
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar_pairs(texts: dict[int, str]) -> list[tuple[int, int]]:
    """All pairs that share 0.8 of their 5-word shingles."""
    sets, holders = {k: shingles(t) for k, t in texts.items()}, {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    common = Counter(pair for ks in holders.values() for pair in combinations(ks, 2))
    pairs = [(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    empty = [k for k, s in sets.items() if not s]
    return pairs + list(zip(empty, empty[1:]))


def first_of_groups(texts: dict[int, str]) -> set[int]:
    root = {k: k for k in texts}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in similar_pairs(texts):
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {k for k in texts if root[k] == k}


def test_near_copies_against_all_pairs(spark, sf_dir):
    """What goes is similar to what stays, by links of brute force, and nine of ten near copies go."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rnd = random.Random(4)
    for k in range(0, 120, 3):  # copies with a few words changed
        words = texts[k].split()
        for _ in range(max(1, len(words) // 60)):
            words[rnd.randrange(len(words))] = "other"
        texts[10_000 + k] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one_copy(docs).collect()}
    must = first_of_groups(texts)
    assert must <= kept
    gone = texts.keys() - must
    assert len(gone) > 100 and len(gone - kept) >= 0.9 * len(gone)
    near = [b for a, b in similar_pairs(texts) if texts[a].lower().split() != texts[b].lower().split()]
    assert sum(k not in kept for k in set(near)) >= 0.9 * len(set(near))


def test_candidates_in_lists_of_all_lengths(spark):
    """Blocks of long lists connect what all pairs by the candidates' rule connect, and no more."""
    rnd = random.Random(5)
    flip = lambda x, n: x ^ sum(1 << k for k in rnd.sample(range(64), n))
    seeds = [(rnd.getrandbits(64), rnd.getrandbits(64)) for _ in range(4)]
    pairs = [(flip(x, rnd.randint(0, 6)), flip(y, rnd.randint(0, 9))) for x, y in seeds for _ in range(12)]
    pairs += [(seeds[0][0], rnd.getrandbits(64)) for _ in range(9)]  # near in one fingerprint only

    def linked(a, b) -> bool:
        differ, other = a[0] ^ b[0], (a[1] ^ b[1]).bit_count()
        tally = sum((differ >> (8 * k)) & 255 == 0 for k in range(8))
        return tally >= simhash.COPY_SHARED and differ.bit_count() <= simhash.COPY_BITS and other <= simhash.OTHER_BITS

    def groups(links) -> list[int]:
        least = list(range(len(pairs)))
        for _ in pairs:
            for a, b in links:
                least[a] = least[b] = min(least[a], least[b])
        return least

    wanted = groups([(a, b) for a in range(len(pairs)) for b in range(a) if linked(pairs[a], pairs[b])])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(k, [signed(x), signed(y)]) for k, (x, y) in enumerate(pairs)], "norm long, fps array<long>")
    for limit in (2, 5, 2048):
        got = [(r.a, r.b) for r in simhash.candidates(nodes, 0, limit).collect()]
        assert all(linked(pairs[a], pairs[b]) for a, b in got)
        assert groups(got) == wanted and len(set(wanted)) < 30


def test_odd_inputs_through_all_stages(spark, sf_dir, tmp_path):
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    text = "an old man walked along the quiet river with his small dog every single day"
    rows = [(1, text), (1, text), (1, "another text with this doc_id, password = abcdef123"), (2, None), (3, ""), (None, text), (4, "x" * 200_000)]
    rows = [(k, t, "en", "s", 0, "f", "n", 1) for k, t in rows]
    kind = "doc_id long, text string, lang string, source string, n_chars long, fp string, norm string, label long"
    docs = spark.createDataFrame(rows, kind)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens > 0) for r in pipeline.run(spark, str(tmp_path)).collect())
    # Null and empty texts are copies of each other; rows without doc_id stay.
    assert got == [(False, 1, True), (False, 1, True), (False, 2, False), (False, 4, True), (True, 0, True)]
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
    empty = tmp_path / "empty"
    for name in ("benchmark", "labels", "documents"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert pipeline.run(spark, str(empty)).count() == 0


def test_rows_against_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.CATEGORIES)
    rows = {k: t for k, t in rows.items() if chain.probabilities(t.encode())[-1] < toxicity.THRESHOLD}
    rows = {k: rows[k] for k in first_of_groups(rows)}
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {k: t for k, t in rows.items() if not any(i in " ".join(t.split()) for i in items)}
    library = Tokenizer.from_file(bpe.default_tokenizer())
    got = {r.doc_id: r for r in pipeline.run(spark, sf_dir).collect()}
    assert got.keys() == rows.keys()
    for k, text in rows.items():
        if not secrets.base_spans(text):
            assert got[k].n_tokens == len(library.encode(text, add_special_tokens=False).ids)


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "encoding"]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes
        kept = out.count()
        assert kept == docs.count() if name == "secrets" else kept < docs.count()
    again = decontaminate.contaminated(
        pipeline.drop_benchmark(spark, docs, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
    assert again.isEmpty()
