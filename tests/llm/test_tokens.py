import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonlake.llm.bpe import DEFAULT_VOCABULARY, Encoder, token_ids
from axonlake.llm.curve_packing import Packer, hilbert_keys, pack, pack_texts, repack

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def odd_texts(n=1500):
    rng = random.Random(3)
    kinds = [
        lambda k: "".join(rng.choice("ab c") for _ in range(k)), lambda k: rng.choice(["0", "ha", " ", "\n", "é", "=-", "the "]) * k, lambda k: "".join(rng.choice("etaoinshrdlu") for _ in range(k)),
        lambda k: "".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x20, 0x7E), rng.randint(0x1F300, 0x1F6FF), rng.randint(0x4E00, 0x9FFF), 0x85, 0xA0, 0x200B, 0x2028, 0x3000])) for _ in range(k)),
    ]
    return [rng.choice(kinds)(rng.randint(0, 120)) for _ in range(n)] + ["<|endoftext|>", "I'm we'll THEY'RE", "0" * 50_000, "ab" * 20_000]


def test_ids_equal_the_library(reference):
    e, texts = Encoder(DEFAULT_VOCABULARY), odd_texts()
    assert [e.encode(t) for t in texts] == reference(texts)


def test_every_token_is_its_own_code():
    e = Encoder(DEFAULT_VOCABULARY)
    ids = random.Random(4).sample(sorted(e.text), 3000)
    assert all(e._encode(e.text[i]) == [i] for i in ids)


def test_column(spark, small, reference):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text", token_ids(F.col("text")).alias("ids")).collect()
    assert [list(r["ids"]) for r in rows] == reference([r["text"] or "" for r in rows])
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "ids long, text string")
    assert [list(r[0]) for r in df.select(token_ids(F.col("text"))).collect()] == [[], [], [64]]
    assert df.limit(0).select(token_ids(F.col("text"))).count() == 0


def test_curve_is_continuous():
    grid = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    keys = hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512)) and np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


def check_packing(placed, sizes, capacity):
    loads, pieces = {}, {}
    for r in placed:
        loads[r["container_id"]] = loads.get(r["container_id"], 0) + r["n"]
        pieces.setdefault(r["i"], []).append((r["piece"], r["start"], r["n"]))
    assert max(loads.values(), default=0) <= capacity and pieces.keys() == sizes.keys()
    for i, size in sizes.items():
        p = sorted(pieces[i])
        assert sum(n for *_, n in p) == size and [k for k, *_ in p] == list(range(len(p))) and all(s == k * capacity for k, s, _ in p)
        assert len(p) == 1 or size > capacity
    return loads


def test_packing(spark):
    rng = random.Random(5)
    sizes = {i: rng.choice([0, 1, 3, 40, 99, 100, 101, 250, rng.randint(1, 60)]) for i in range(4000)}
    df = spark.createDataFrame([(i, n, rng.randint(0, 50)) for i, n in sizes.items()], "i long, size int, key int")
    placed = pack(df, "i", "size", "key", 100, open_containers=8, range_containers=50)
    loads = check_packing(placed.collect(), sizes, 100)
    again = check_packing(repack(placed, 100).collect(), sizes, 100)
    assert len(again) <= len(loads) and sum(sizes.values()) / (100 * len(again)) > 0.95
    assert pack(df.limit(0), "i", "size", "key", 100).count() == 0


def test_best_fit():
    p = Packer(10, 2, 0)
    assert [p.place(n) for n in (6, 7, 3, 4, 9, 8, 1)] == [0, 1, 1, 0, 2, 3, 2]


def test_texts(spark, reference):
    texts = [None, "", "x", "a b c " * 900, "same", "same"] + ["word " * k for k in range(1, 120)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "i long, text string, size int")
    placed = pack_texts(df, "i", "text", 512).withColumnRenamed("doc_id", "i").collect()
    check_packing(placed, {i: len(reference([t or ""])[0]) for i, t in enumerate(texts)}, 512)
