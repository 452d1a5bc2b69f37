import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillon.llm import packing as pk

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_are_the_library_s():
    texts = ["", "It's  WE'RE ÀÉ ß ªº ²1½ <|startoftext|>x", "日本 É", "éa", "--'s ''s x'LL", "a\x85b\xa0c\x1cd", "x" * 900]
    texts += [f"aB{chr(c)}b {chr(c)}1{chr(c)}' {chr(c)}{chr(c)}" for c in range(256)]
    assert [np.frombuffer(b, "<u4").tolist() for b in pk.Encoder(PATH).encode(texts)] == [ids(t)[:-1] for t in texts]


def test_differencing_splits_evenly():
    rng = random.Random(7)
    for _ in range(40):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(1, 60))]
        k = rng.randint(1, 12)
        split = pk.differencing(lengths, k)
        assert sorted(i for _, items in split for i in items) == list(range(len(lengths)))
        assert all(load == sum(lengths[i] for i in items) for load, items in split) and len(split) <= k
        if len(lengths) > 6 * k:
            assert max(x for x, _ in split) - min(x for x, _ in split) <= 12
        assert all(sum(lengths[i] for i in items) <= 64 for items in pk.windows_of(lengths, 64))
    assert pk.differencing([8, 7, 6, 5, 4], 2)[-1][0] == 16  # the known example: loads 14 and 16


def test_each_id_lies_in_one_place(spark):
    rows = [(1, None, 0), (1, None, 0), (2, "", 0), (3, "one two three", 0), (4, "word, " * 900, 0), (None, "x", 0), (5, "a b c d e f g " * 60, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").repartition(1)
    out = pk.pack(docs, PATH, capacity=256, end_id=2).toPandas()
    assert (out["length"] > 0).all()
    for doc, text, _ in rows:
        own = out[out.doc_id.isna() if doc is None else out.doc_id == doc].sort_values("start")
        told = ids(text)
        if doc != 1:
            assert own["length"].sum() == len(told) == own["doc_tokens"].iloc[0]
        for r in own.itertuples():
            assert zlib.crc32(np.array(told[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert len(out[out.doc_id == 1]) == 2
    for _, window in out.groupby("sequence_id"):
        window = window.sort_values("offset")
        assert window["offset"].tolist() == (window["length"].cumsum() - window["length"]).tolist() and window["length"].sum() <= 256
    assert pk.pack(docs.limit(0), PATH).count() == 0
