import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldloom.llm.common import text_bytes
from fieldloom.llm.dac import Segment, encode, read_documents, tokens_at, word_ids, write_tokens
from fieldloom.llm.tokenizing import byte_level_edges

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=3000), st.randoms())
def test_round_trip_and_random_access(ids, rng):
    ids = np.array(ids, np.uint32)
    segment = Segment(encode(ids))
    assert len(segment) == len(ids)
    assert (segment.read(0, len(ids)) == ids).all()
    if len(ids):
        at = np.array([rng.randrange(len(ids)) for _ in range(50)])
        assert (segment.take(at) == ids[at]).all()
        a, b = sorted((rng.randrange(len(ids) + 1), rng.randrange(len(ids) + 1)))
        assert (segment.read(a, b) == ids[a:b]).all()
        with pytest.raises(IndexError):
            segment.take(np.array([len(ids)]))


def test_words_give_the_ids_of_whole_texts():
    import pyarrow as pa

    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "word", " word", "'s", "'", "12", ".", "!", "é", "日", "👍", "\r\n", "don't", "<|endoftext|>", "　", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    data, bounds = text_bytes(pa.array(texts))
    ids, ends = word_ids(PATH)(data, byte_level_edges(data, bounds), bounds)
    whole = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    assert all(ids[a:b].tolist() == x.ids for a, b, x in zip(ends[:-1], ends[1:], whole))


def expected(rows):
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_hold_all_documents_in_order(spark, documents, tmp_path):
    path = str(tmp_path / "tokens")
    write_tokens(documents, PATH, path)
    got = sorted(tuple(r) for r in read_documents(spark, path).collect())
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    assert got == expected(rows)
    tokenizer = Tokenizer.from_file(PATH)
    every = [i for _, t in rows for i in [*tokenizer.encode(t, add_special_tokens=False).ids, 0]]
    at = random.Random(1).sample(range(len(every)), 200)
    positions = spark.createDataFrame([(p,) for p in [*at, None, -1, len(every)]], "position bigint")
    found = {r.position: r.token_id for r in tokens_at(spark, path, positions).collect()}
    assert found == {p: every[p] for p in at}


def test_odd_and_empty_tables(spark, odd, empty, tmp_path):
    write_tokens(odd, PATH, str(tmp_path / "odd"))
    got = [tuple(r) for r in read_documents(spark, str(tmp_path / "odd")).orderBy("start").collect()]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert [r[0] for r in got] == [None, None, 1, 2, 4, 4, 5, 6, 7, 8]
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in expected(rows))
    assert got[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    write_tokens(empty, PATH, str(tmp_path / "empty"))
    assert read_documents(spark, str(tmp_path / "empty")).collect() == []
