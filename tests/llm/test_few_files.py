"""Intermediate tables of few rows take few files, however many tasks make them."""

import os
import random

from test_findings_r02 import copies_of

from larkspur.llm import simhash


def test_small_tables_take_few_files(spark):
    folder, setting = spark.conf.get("spark.checkpoint.dir"), "spark.sql.shuffle.partitions"
    texts = copies_of(random.Random(13), 60, 12, 120)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    before, former = set(os.listdir(folder)), spark.conf.get(setting)
    spark.conf.set(setting, "24")
    try:
        kept = simhash.keep_one_copy(docs).count()
    finally:
        spark.conf.set(setting, former)
    assert 0 < kept < len(texts)
    files: dict[str, int] = {}
    for made in set(os.listdir(folder)) - before:
        name, parts = made.split("-")[1], sum(x.endswith(".parquet") for x in os.listdir(f"{folder}/{made}"))
        files[name] = max(files.get(name, 0), parts)
    assert {"lists", "meetings", "pairs"} <= set(files)
    assert files.get("mixed", 0) + files["lists"] + files["meetings"] <= 4, files
