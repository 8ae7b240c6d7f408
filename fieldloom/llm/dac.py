"""Token ids as directly addressable codes, and the token files made of them."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import prepare, slices, text_bytes
from fieldloom.llm.tokenizing import WordIds, byte_level_edges

# Mark and byte order of a segment, bits of a chunk, bits per entry of the rank directory.
MAGIC = b"DAC1"
CHUNK_BITS = 8
RANK_BITS = 512
#: Tokens after which a segment ends with its document.
SEGMENT_TOKENS = 1 << 18
END_ID = 0

_ENCODERS: dict[str, WordIds] = {}
SEGMENTS = "part int, seg int, start_in_part bigint, n_tokens bigint, doc_ids array<bigint>, ends array<bigint>, payload binary"


def encode(ids: np.ndarray) -> bytes:
    """A segment: per level the chunks, their continuation bitmap and its rank directory."""
    out = [MAGIC, struct.pack("<Q", len(ids))]
    rest = np.asarray(ids, np.uint32)
    while True:
        more = rest >> CHUNK_BITS
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little").tobytes()
        bits += b"\0" * (-len(bits) % (RANK_BITS // 8))
        counts = np.bitwise_count(np.frombuffer(bits, "<u8")).reshape(-1, RANK_BITS // 64).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        out += [struct.pack("<QI", len(rest), int(goes_on.any())), (rest & 0xFF).astype(np.uint8).tobytes(), bits, ranks.tobytes()]
        if not goes_on.any():
            return b"".join(out)
        rest = more[goes_on]


class Segment:
    """Random access to the ids of an encoded segment; no block is decoded."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.length = struct.unpack_from("<Q", raw, 4)[0]
        self.levels, at, more = [], 12, 1
        while more:
            n, more = struct.unpack_from("<QI", raw, at)
            at += 12
            chunks = np.frombuffer(raw, np.uint8, n, at)
            at += n
            blocks = -(-n // RANK_BITS)
            words = np.frombuffer(raw, "<u8", blocks * RANK_BITS // 64, at)
            at += words.nbytes
            ranks = np.frombuffer(raw, "<u4", blocks + 1, at)
            at += ranks.nbytes
            self.levels.append((chunks, words, ranks))

    def __len__(self) -> int:
        return self.length

    def take(self, positions: np.ndarray) -> np.ndarray:
        """Ids at any positions, in the order asked for."""
        at = np.asarray(positions, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.length):
            raise IndexError("position outside the segment")
        out, live = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunks, words, ranks) in enumerate(self.levels):
            out[live] |= chunks[at].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            on = (words[word] >> bit) & np.uint64(1) == 1 if len(at) else np.zeros(0, bool)
            live, word, bit, at = live[on], word[on], bit[on], at[on]
            rank = ranks[at // RANK_BITS].astype(np.int64)
            first = at // RANK_BITS * (RANK_BITS // 64)
            for k in range(RANK_BITS // 64):
                inside = first + k < word
                rank[inside] += np.bitwise_count(words[(first + k)[inside]])
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            at = rank + np.bitwise_count(below)
        return out

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids of a run, from one rank per level."""
        out, live = np.zeros(stop - start, np.uint32), np.arange(stop - start)
        for level, (chunks, words, ranks) in enumerate(self.levels):
            out[live] |= chunks[start:stop].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            first = start // 8
            bits = np.unpackbits(words.view(np.uint8)[first : -(-stop // 8)], bitorder="little")
            bits = bits[start - first * 8 : stop - first * 8].view(bool)
            block = start // RANK_BITS
            head = words[block * (RANK_BITS // 64) : start >> 6]
            rank = int(ranks[block]) + int(np.bitwise_count(head).sum())
            if start & 63:
                rank += int(np.bitwise_count(words[start >> 6] & np.uint64((1 << (start & 63)) - 1)))
            live = live[bits]
            start, stop = rank, rank + len(live)
            if start == stop:
                break
        return out


def word_ids(path: str) -> WordIds:
    """The worker's encoder for a byte-level tokenizer file; kept between tasks."""
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        leads = np.zeros(tokenizer.get_vocab_size(), bool)
        leads[[i for piece, i in tokenizer.get_vocab().items() if piece[0] == "Ġ"]] = True
        _ENCODERS[path] = WordIds(tokenizer, leads)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, each followed by ``END_ID``, in ascending id order.

    A file is a Parquet container of segments; a segment holds whole documents, their
    ids and the ends of their runs. Documents are dealt by range of (id, text hash), so
    that repeated ids do not meet in one task, and ordered by id, hash and text. A null
    text is empty, a null id comes first; other columns are left behind; an empty table
    gives no segment.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def segments(batches):
        part, seg, start = TaskContext.get().partitionId(), 0, 0
        names, runs, total = [], [], 0

        def flush():
            nonlocal seg, start, names, runs, total
            sizes = np.concatenate([np.diff(bounds) for _, bounds in runs])
            payload = encode(np.concatenate([ids for ids, _ in runs]))
            row = [part, seg, start, total, pa.concat_arrays(names).to_pylist(), np.cumsum(sizes).tolist(), payload]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[c.split()[0] for c in SEGMENTS.split(", ")])
            seg, start, names, runs, total = seg + 1, start + total, [], [], 0
            return out

        for batch in batches:
            for rows in slices(batch, limit=SEGMENT_TOKENS * 3):
                data, bounds = text_bytes(rows.column("text"))
                ids, ends = word_ids(tokenizer_path)(data, byte_level_edges(data, bounds), bounds)
                ids = np.insert(ids, ends[1:], END_ID)
                ends = ends + np.arange(len(ends))
                names.append(rows.column("doc_id"))
                runs.append((ids, ends))
                total += len(ids)
                if total >= SEGMENT_TOKENS:
                    yield flush()
        if runs:
            yield flush()

    ordered.mapInArrow(segments, SEGMENTS).write.option("parquet.enable.dictionary", "false").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the number of tokens in all segments before them."""
    stored = spark.read.schema(SEGMENTS).parquet(path)
    sizes = stored.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    # One row per partition of the writing job, whatever the number of documents.
    starts = sizes.selectExpr("part", "sum(part_tokens) over (order by part) - part_tokens as part_start")
    return stored.join(F.broadcast(starts), "part").selectExpr("part_start + start_in_part as start", "doc_ids", "ends", "payload")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: its place among all tokens, its length and its ids' crc32."""
    prepare(spark)

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                segment, begin = Segment(row["payload"]), 0
                out = []
                for doc_id, end in zip(row["doc_ids"], row["ends"]):
                    ids = segment.read(begin, end).astype("<u4")
                    out.append((doc_id, row["start"] + begin, end - begin, zlib.crc32(ids.data)))
                    begin = end
                columns = [pa.array(x, pa.int64()) for x in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_segments(spark, path).mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame, column: str = "position") -> DataFrame:
    """The id at each position among all tokens; positions outside or null are left out.

    Segments and positions meet by segment, found from the index columns alone.
    """
    prepare(spark)
    index = read_segments(spark, path)

    def lookup(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = np.array(row["wanted"], np.int64)
                ids = Segment(row["payload"]).take(at - row["start"])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids.astype(np.int64))], names=["position", "token_id"])

    wanted = positions.select(F.col(column).cast("bigint").alias("position")).dropna()
    bucket = F.floor(F.col("position") / SEGMENT_TOKENS)
    spread = index.selectExpr("start", "start + element_at(ends, -1) as stop").selectExpr(
        "start", "stop", f"explode(sequence(start div {SEGMENT_TOKENS}, (stop - 1) div {SEGMENT_TOKENS})) as bucket"
    )
    hits = wanted.withColumn("bucket", bucket).join(spread, "bucket").where("position >= start and position < stop")
    lists = hits.groupBy("start", (F.xxhash64("position") % 64).alias("lot")).agg(F.collect_list("position").alias("wanted"))
    return index.select("start", "payload").join(lists, "start").mapInArrow(lookup, "position bigint, token_id bigint")
