import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bagtree.llm.coder import decode_block, encode_block
from bagtree.llm.files import open_input
from bagtree.llm.separators import count_documents, document_token_counts
from bagtree.llm.token_files import BlockWriter, read_blocks, read_documents, write_token_files
from bagtree.llm.tokens import TextEncoder, drops_white_space
from tests.llm.helpers import DOCUMENTS, clashing, documents, rows

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(texts, path=WORDS, literal=False):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = literal
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 49_407), min_size=1, max_size=900), st.integers(1, 4))
def test_coder_round_trip(ids, repeats):
    data = np.array(ids * repeats, np.uint32)
    steps, words, payload = encode_block(data, 49_408)
    assert (decode_block(len(data), steps, words, payload, 49_408) == data).all()


def test_coder_saves_on_skewed_and_repeated_ids():
    rng = np.random.default_rng(1)
    skewed = np.minimum(rng.zipf(1.5, 60_000), 49_407).astype(np.uint32)
    repeated = np.tile(rng.integers(0, 49_408, 500).astype(np.uint32), 200)
    for ids, most in ((skewed, 0.45), (repeated, 0.5)):
        steps, words, payload = encode_block(ids, 49_408)
        assert (decode_block(len(ids), steps, words, payload, 49_408) == ids).all()
        assert len(payload) < most * 2 * len(ids)
    with pytest.raises(ValueError):
        encode_block(np.array([49_408], np.uint32), 49_408)


def test_blocks_are_cut_anywhere_and_checked(tmp_path):
    path = str(tmp_path / "x.trc")
    rng = np.random.default_rng(2)
    docs = [(i if i != 3 else None, rng.integers(0, 900, n).astype(np.uint32)) for i, n in enumerate([0, 5, 1, 700, 64, 0, 130])]
    writer = BlockWriter(path, 1000, block_ids=64)
    for doc, ids in docs:
        writer.add(doc, ids)
    writer.finish()
    with open_input(path) as stream:
        blocks = list(read_blocks(stream))
    assert all(len(ids) <= 64 for ids, *_ in blocks) and (np.concatenate([b[0] for b in blocks]) == np.concatenate([d[1] for d in docs])).all()
    data = bytearray((tmp_path / "x.trc").read_bytes())
    data[-5] ^= 1
    (tmp_path / "y.trc").write_bytes(data)
    with open_input(str(tmp_path / "y.trc")) as stream, pytest.raises(ValueError):
        list(read_blocks(stream))


def test_word_cache_gives_the_tokenizers_ids():
    rng = random.Random(3)
    letters = list("abcXYZ.,!?'`#|0189 \n\t éÉß́İΣς中ﬁ") + [" "] * 10 + ["<|endoftext|>", "\x01", " ", "\xa0", "'s", "'re "]
    small = TextEncoder(WORDS, True, max_words=300)
    for n in range(60):
        extra = ["\x1c"] if n % 10 == 0 else []
        texts = ["".join(rng.choice(letters + extra) for _ in range(rng.randint(0, 150))) for _ in range(12)] + [None, "", " "]
        ids, counts = small.encode(texts)
        expected = plain_ids(texts)
        assert counts.tolist() == [len(x) for x in expected] and ids.tolist() == [i for x in expected for i in x]
    scripts = "aBñŐŉıĳǅȺЖёӁぁヺ中龥가힣\u0301\u0338\u1100ΑΩẞK#$%&*().,'<|>-=0²Ⅷ"
    texts = [" ".join("".join(rng.choice(scripts) for _ in range(rng.randint(1, 6))) for _ in range(40)) for _ in range(200)]
    ids, counts = TextEncoder(WORDS, True).encode(texts)
    assert ids.tolist() == [i for x in plain_ids(texts) for i in x]
    assert drops_white_space(WORDS) and not drops_white_space(BYTES)
    texts = ["a  b\n c", "", None, "x <|endoftext|> y"]
    ids, counts = TextEncoder(BYTES, False, literal_specials=True).encode(texts)
    assert ids.tolist() == [i for x in plain_ids(texts, BYTES, True) for i in x]


def expected_documents(data):
    """In order of doc_id (null first): doc_id, start, n_tokens, crc; rows with one doc_id in any order."""
    ids = [x + [2] for x in plain_ids([r[1] for r in data])]
    return [(r[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(data, ids)]


def test_files_give_back_every_document(spark):
    data = rows(n=25)
    for options in ({}, {"file_text_bytes": 5000}):
        files = write_token_files(clashing(documents(spark, data), "part", "start"), WORDS, **options)
        got = read_documents(files).collect()
        key = lambda r: (r[0] is not None, r[0] or 0)
        assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(expected_documents(data), key=repr)
        in_order = sorted(got, key=lambda r: r.start)
        assert [key(r) for r in in_order] == sorted(key(r) for r in got)
        starts = np.cumsum([0] + [r.n_tokens for r in in_order])[:-1].tolist()
        assert [r.start for r in in_order] == starts
        assert files.agg(F.sum("n_docs")).first()[0] == len(data)


def test_no_documents(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert read_documents(write_token_files(empty, WORDS)).collect() == []
    assert document_token_counts(empty, WORDS).collect() == []


def test_separator_scan_over_block_borders(spark, tmp_path):
    rng = np.random.default_rng(5)
    files, expected = [], set()
    for part, (n, closed) in enumerate([(40, True), (25, False), (0, True), (1, False)]):
        lengths = rng.choice([0, 1, 2, 30], n)
        ids, start = [], 0
        for k, length in enumerate(lengths.tolist()):
            ids += rng.integers(0, 9, length).tolist()
            last_open = not closed and k == n - 1
            if not last_open:
                ids.append(99)
            if not last_open or length:
                expected.add((part, k, start, length, not last_open))
            start += length + 1
        data = np.array(ids, "<u2").tobytes()
        (tmp_path / f"{part}.bin").write_bytes(data)
        files.append((part, str(tmp_path / f"{part}.bin"), len(data)))
    table = spark.createDataFrame(files, "part int, path string, bytes long")
    for block in (2, 6, 14, 1 << 20):
        got = count_documents(table, end_id=99, block_bytes=block).collect()
        assert {(r.part, r.ordinal, r.start, r.n_tokens, r.complete) for r in got} == expected and len(got) == len(expected)


def test_token_counts_of_documents(spark):
    data = rows(n=25) + [(77, "a <|endoftext|> b", "en", "s", 1)]
    got = document_token_counts(clashing(documents(spark, data).repartition(3), "part", "ordinal"), WORDS).collect()
    expected = sorted(((r[0], len(x)) for r, x in zip(data, plain_ids([r[1] for r in data], literal=True))), key=repr)
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == expected
    assert isinstance(got[0].n_tokens, int) and pa.uint16().bit_width == 16
