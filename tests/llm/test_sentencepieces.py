import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from fieldloom.llm.sentencepieces import BYTE, CONTROL, UNIGRAM, UNKNOWN, Codec, Model, build_tokenizer, decode_documents, encode_documents, parse_model

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "   ", "\n", "\t", "a", "b", "'s", "1", "23", ".", "é", "日", "👍", "\r\n", "don't", "<s>", "　", "aaaa", "===", "the", "ing", "▁", "</s>", "<0x0A>", "\x00"]


@pytest.fixture(scope="module")
def codec():
    return Codec(PATH, 1, True)


def some_texts(n=4000):
    rng = random.Random(1)
    return ["", *("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n))]


def test_parity_with_the_library(codec):
    texts = some_texts()
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    seen = codec.normalise(pa.array(texts))
    ids, bounds, differ = codec.encode(seen)
    want = library.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    assert not differ.any()
    assert [x.ids for x in codec.whole.encode_batch(texts, add_special_tokens=False)] == want
    back = codec.decode(ids, bounds)
    assert back == [library.decode(x) for x in want] == [codec.whole.decode(x) for x in want]


def test_model_file(codec):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    with open(PATH, "rb") as f:
        model = parse_model(f.read())
    assert len(model.pieces) == library.get_piece_size() and model.independent_words and model.byte_fallback
    for i in range(0, len(model.pieces), 37):
        assert model.pieces[i][0] == library.id_to_piece(i) and model.pieces[i][1] == pytest.approx(library.get_score(i))


def test_unigram_takes_the_best_path_and_falls_back_to_bytes():
    pieces = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL), ("▁ab", -1.0, 1), ("▁a", -2.0, 1), ("b", -2.5, 1), ("c", -3.0, 1), ("▁", -4.0, 1), ("bc", -3.2, 1)]
    pieces += [(f"<0x{i:02X}>", 0.0, BYTE) for i in range(256)]
    model = Model(pieces, UNIGRAM, True, dummy_prefix=True, squeeze_spaces=True)
    tokenizer = build_tokenizer(model)
    assert tokenizer.encode("  ab   abc ").tokens == ["▁ab", "▁ab", "c"]  # -4 beats -5.2 of ▁a bc
    assert tokenizer.encode("é").tokens == ["▁", "<0xC3>", "<0xA9>"]
    assert tokenizer.decode(tokenizer.encode("ab é").ids) == "ab é"


def test_documents(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    encoded = encode_documents(documents, PATH)
    for r in encoded.join(documents, "doc_id").collect():
        ids = library.encode(r.text)
        assert r.ids == ids and r.n_tokens == len(ids) and r.same_as_library and r.round_trip
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert {r.doc_id: r.text for r in decode_documents(encoded, PATH).collect()} == texts


def test_odd_and_empty_tables(odd, empty):
    got = encode_documents(odd, PATH).collect()
    assert len(got) == 10 and all(r.same_as_library and r.round_trip for r in got)
    assert sorted(r.n_tokens for r in got)[:3] == [0, 0, 0]
    back = decode_documents(encode_documents(odd, PATH).withColumnRenamed("doc_id", "TEXT"), PATH)
    assert "TEXT" not in back.columns and sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in odd.collect())
    assert encode_documents(empty, PATH).collect() == [] and decode_documents(encode_documents(empty, PATH), PATH).collect() == []
