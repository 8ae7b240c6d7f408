"""SentencePiece models on the tokenizers library: encode, decode and compare."""

from __future__ import annotations

import os
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import prepare, slices, text_bytes, with_column
from fieldloom.llm.tokenizing import WordIds, space_edges

# Field numbers and piece kinds of the public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"


def _fields(raw: bytes):
    """(number, value) of a protobuf message; values are ints, 4-byte or longer bytes."""

    def varint(at):
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if byte < 0x80:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    """What a model file says: pieces with scores and kinds, and its normaliser."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True

    @property
    def unknown_id(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def independent_words(self) -> bool:
        """Whether no piece goes on past a mark, so that words never share one."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def parse_model(raw: bytes) -> Model:
    model = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            spec = dict(_fields(value))
            model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze_spaces = bool(spec.get(3, 1)), bool(spec.get(4, 1))
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """All pairs that make a piece, best piece first."""
    score = {p: s for p, s, kind in model.pieces if kind == NORMAL}
    place = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    found = [
        (-score[p], place[p[:k]], place[p[k:]], p[:k], p[k:])
        for p in score
        for k in range(1, len(p))
        if p[:k] in score and p[k:] in score
    ]
    return [(left, right) for *_, left, right in sorted(found)]


def build_tokenizer(model: Model, prefix: bool = True):
    """A tokenizers pipeline of the model: normaliser, marks, scores or merges, byte fallback."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    hidden = [p if kind in (NORMAL, BYTE, UNKNOWN, USER_DEFINED) else f"﷐{i}" for i, (p, _, kind) in enumerate(model.pieces)]
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, (_, s, _) in zip(hidden, model.pieces)], model.unknown_id, model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE(
            {p: i for i, p in enumerate(hidden)},
            _merges(model),
            unk_token=hidden[model.unknown_id],
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix and prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", int(model.dummy_prefix), 0)]
    )
    own = [p for p, _, kind in model.pieces if kind == USER_DEFINED]
    tokenizer.add_tokens([AddedToken(p, normalized=True) for p in own])
    return tokenizer


class Codec:
    """Encodes and decodes rows of UTF-8 text; compares with the model's own library.

    Where no piece goes on past a space, distinct words are encoded once and compared
    with the library word by word; else whole rows are.
    """

    def __init__(self, path: str, threads: int, compare: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as f:
            self.model = parse_model(f.read())
        self.plain = not self.model.charsmap and not self.model.squeeze_spaces
        self.whole = build_tokenizer(self.model)
        leads = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        bare = build_tokenizer(Model(**{**self.model.__dict__, "charsmap": b"", "squeeze_spaces": False}), prefix=False)
        self.words = WordIds(bare, leads)
        if compare:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            skip = int(self.model.dummy_prefix)
            self.words.reference = lambda words: library.encode([w[skip:] for w in words], num_threads=threads)
        pieces = [self._bytes(i, p, kind) for i, (p, _, kind) in enumerate(self.model.pieces)]
        self.bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def _bytes(self, i: int, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def normalise(self, text: pa.Array) -> pa.Array:
        """The texts as the model sees them, with a space for each mark."""
        if not self.plain:
            done = [self.whole.normalizer.normalize_str(t).replace(MARK, " ") for t in text.to_pylist()]
            return pa.array(done, pa.string())
        prefix = " " if self.model.dummy_prefix else ""
        return pa.array([prefix + t.replace(MARK, " ") if t else t for t in text.to_pylist()], pa.string())

    def encode(self, seen: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of normalised rows, the rows' bounds in them, words that differ from the library's."""
        data, bounds = text_bytes(seen)
        edges = space_edges(data, bounds) if self.model.independent_words else np.unique(np.append(bounds, len(data)))
        ids, ends = self.words(data, edges, bounds)
        return ids, ends, self.words.differ

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of rows of ids; bytes that are no UTF-8 become replacement marks."""
        starts = self.bounds[ids]
        sizes = self.bounds[ids.astype(np.int64) + 1] - starts
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.data[np.arange(int(ends[-1])) + np.repeat(starts - ends[:-1], sizes)].tobytes()
        edges = ends[bounds]
        skip = self.model.dummy_prefix
        return [
            raw[a + (skip and raw[a : a + 1] == b" ") : b].decode("utf-8", "replace")
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())
        ]


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, threads: int = 2, compare: bool = False) -> Codec:
    """The worker's codec of a model file; kept between tasks."""
    key = (path, threads, compare)
    if key not in _CODECS:
        _CODECS[key] = Codec(path, threads, compare)
    return _CODECS[key]


def encode_documents(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, threads: int = 2
) -> DataFrame:
    """Per document its ids, their number and crc32 (little-endian unsigned 32-bit), and checks.

    ``same_as_library`` is false where a word's ids differ from the model's own library,
    ``round_trip`` where decoding does not give back the text as the normaliser left it.
    Whole texts are encoded. A null text is empty and has no ids; null and repeated ids
    stay; other columns are ignored; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    schema = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, same_as_library boolean, round_trip boolean"
    schema += ", ids array<int>" if keep_ids else ""

    def run(batches):
        own = codec(model_path, threads, True)
        skip = int(own.model.dummy_prefix)
        for batch in batches:
            for part in slices(batch):
                seen = own.normalise(part.column("text"))
                ids, bounds, differ = own.encode(seen)
                back = own.decode(ids, bounds)
                flat = ids.astype("<u4")
                crc = [zlib.crc32(flat[a:b].data) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                columns = [
                    part.column("doc_id"),
                    pa.array(np.diff(bounds)),
                    pa.array(crc, pa.int64()),
                    pa.array(differ == 0),
                    pa.array([a[skip:] == b for a, b in zip(seen.to_pylist(), back)], pa.bool_()),
                ]
                names = ["doc_id", "n_tokens", "ids_crc32", "same_as_library", "round_trip"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def decode_documents(rows: DataFrame, model_path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of each row's ids in ``out``; a null list gives a null text."""
    prepare(rows.sparkSession)
    kept = [c for c in rows.columns if c.lower() != out.lower()]
    schema = with_column(rows.select(*kept).schema, out, "string")

    def run(batches):
        own = codec(model_path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            full = lists.fill_null([]) if lists.null_count else lists
            sizes = np.array([len(x) for x in full], np.int64)
            texts = own.decode(full.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))
            texts = [t if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, out])

    return rows.mapInArrow(run, schema)
