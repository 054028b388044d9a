import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skein.llm import token_files as T

SF = "/root/testdata/sf0.001"


def brute(rows):
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("lanes,block", [(1, 5), (4, 64), (64, 1000), (1024, 1 << 18)])
def test_sections_round_trip(lanes, block):
    r = np.random.default_rng(lanes)
    docs = [np.minimum(r.zipf(1.3, size=int(n)), 50000).astype(np.uint32) for n in r.integers(0, 900, 40)]
    back = T.decode_section(T.encode_section(docs, lanes, block))
    assert len(back) == len(docs) and all((a == b).all() for a, b in zip(back, docs))


def test_runs_decode_from_their_checkpoints_in_any_order():
    r = np.random.default_rng(1)
    docs = [np.minimum(r.zipf(1.3, size=int(n)), 50000).astype(np.uint32) for n in r.integers(0, 9000, 30)]
    section = T.encode_section(docs, 16, 20_000)
    made, whole = T.Section(section), np.concatenate(docs)
    places = [(b, i) for b, block in enumerate(made.blocks) for i in range(len(block[3]))]
    assert len(places) > 60
    with ThreadPoolExecutor(4) as pool:  # each from its own checkpoint, the last first
        runs = dict(zip(places[::-1], pool.map(lambda p: T.Section(section).run(*p), places[::-1])))
    assert (np.concatenate([runs[p] for p in places]) == whole).all()
    for first, last in ((0, 1), (5, 5), (2047, 2049), (30_001, 71_234), (len(whole) - 3, len(whole) + 9)):
        assert (made.span(first, last) == whole[first:last]).all()


def test_words_take_their_ids_from_the_library():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["plain words, and some. More: x? 'tis I'll ab1 c_d é, naïve; ÿ. ŉa ɐb, ǅ", ",. a", " lead", "Trail ", "ª. º", "a\u0345b, \u00aa", "the, the. thethe"]
    t = Tokenizer.from_file(path)
    assert [list(x) for x in T.Encoder(path).encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_a_damaged_section_is_noticed():
    section = bytearray(T.encode_section([np.arange(5000, dtype=np.uint32)], 16, 100))
    section[-3] ^= 1
    with pytest.raises(ValueError):
        T.decode_section(bytes(section))


def test_one_symbol_and_no_documents():
    assert T.decode_section(T.encode_section([])) == []
    assert (T.decode_section(T.encode_section([np.full(5000, 7, np.uint32)]))[0] == 7).all()


def test_odd_texts(spark):
    rows = [(5, " a  b"), (None, None), (3, ""), (3, "x\n y <|endoftext|> z "), (9, "tab\t x\x1c y  z  "), (9, "tab\t x\x1c y  z  "), (1, "w" * 5000), (2, " "), (7, "é" * 300 + " don't 12 345")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS start")
    got = sorted(map(tuple, T.token_file_digest(df).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    ranged = T.read_tokens(T.write_tokens(df, str(public_tokenizers.path("byte_bpe_50k.json")), most_bounds=1))
    assert sorted(map(tuple, ranged.collect()), key=lambda r: r[1]) == got


def test_empty_table(spark):
    assert T.token_file_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, T.op9_token_files(spark, SF).collect()), key=lambda r: r[1]) == brute(rows)
