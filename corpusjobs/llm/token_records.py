"""Token ids in files of length-delimited binary records, with an index for reads in any order.

Shard file: the magic bytes `CJTOKEN1`, then records. A record is the payload's length (8 bytes,
little-endian), the masked checksum of these 8 bytes (4 bytes), the payload, and the masked checksum
of the payload (4 bytes). The mask rotates a CRC-32 right by 15 bits and adds 0xA282EAD8, so that
checksums of data that holds checksums stay useful. Payload: doc_id (8 bytes, signed; the smallest
value stands for null), bytes per id (1 byte: 2 where all ids of the file's vocabulary fit, else 4),
then the ids. Index file (the shard's name with .idx): for each record its offset and the number of
ids before it in the shard, 8 bytes each; a reader of shuffled records needs nothing else.

Documents are dealt to shards by ranges of doc_id, so shard after shard holds them in ascending
order (nulls first, repeated ids by a hash of their text). A task writes files under names of its own
try; only those that the manifest names count, so a task may fail and be tried again.

Null text counts as empty: its record holds the end id alone. Rows with equal ids and texts have equal records, in either
order. Texts of any length are one record. An empty table gives an empty result; columns other than doc_id
and text aren't read, whatever their names.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusjobs.llm.common import scratch

MAGIC = b"CJTOKEN1"
NO_ID = -(2**63)
#: New stems, and new other words, in a turn of a Python worker's memory; those not used in the last two turns are forgotten.
STEMS, WORDS = 250_000, 50_000
#: Code points of a word that is worth remembering.
LONG = 64
#: What the vocabulary's split takes apart: letters, and the ASCII marks behind them.
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and c not in "ªµº")
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: Documents, and bytes of their texts, that are encoded and written with one call; a longer text comes alone.
ROWS, BYTES = 4_096, 4_000_000
#: Records that are read with one call.
TOGETHER = 256


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview, at: int) -> tuple[bytes, int]:
    """The payload of the record at an offset, and where the next one starts; damaged records raise ValueError."""
    size = bytes(data[at : at + 8])
    if struct.unpack("<I", data[at + 8 : at + 12])[0] != masked(size):
        raise ValueError(f"the length at {at} is damaged")
    end = at + 12 + struct.unpack("<Q", size)[0]
    payload = bytes(data[at + 12 : end])
    if struct.unpack("<I", data[end : end + 4])[0] != masked(payload):
        raise ValueError(f"the record at {at} is damaged")
    return payload, end + 4


def byte_letter(b: int) -> str:
    """The character that byte-level vocabularies spell a byte with: itself if it prints, else one from 256 upwards."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return chr(b) if b in prints else chr(256 + sum(x not in prints for x in range(b)))


class WordEncoder:
    """Ids of whole texts by the tokenizers library, which is asked once for each stem that isn't remembered.

    The vocabulary's own steps (NFC, lower case, a split that drops white space) never reach across
    ASCII white space, so a text's ids are those of its words, one after the other. Arrow splits many texts
    at once and finds their different words. A word of Latin letters, with marks behind it or not, has the
    ids of its letters in lower case (its stem) and of the marks; only different stems come to Python.
    A text that holds one of the vocabulary's special tokens goes to the library as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has dealt out the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = "<u2" if self.library.get_vocab_size() <= 65536 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.model = self.library.model
        self.special = "|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values())
        self.letters = [byte_letter(b) for b in range(256)]
        # Lower-case letters pass all steps before the model unchanged, but for the spelling of their bytes.
        self.direct = all(self.model_ids(x) == self.text_ids(x) for x in ("the", "straße", "été", "niño", "a", "internationalisation"))
        self.stems: dict[str, bytes] = {}
        self.stems_before: dict[str, bytes] = {}  # those of the turn before
        self.words: dict[str, bytes] = {}  # whole words of other kinds, and marks
        self.words_before: dict[str, bytes] = {}

    def text_ids(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def model_ids(self, stem: str) -> bytes:
        spelled = stem if stem.isascii() else "".join([self.letters[b] for b in stem.encode()])
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def whole(self, word: str) -> bytes:
        """Ids of a word that is taken as it stands."""
        if (ids := self.words.get(word)) is None:
            if (ids := self.words_before.get(word)) is None:
                ids = self.text_ids(word)
            if len(word) <= LONG:
                if len(self.words) >= WORDS:
                    self.words_before, self.words = self.words, {}
                self.words[word] = ids
        return ids

    def stem(self, low: str) -> bytes:
        """Ids of Latin letters in lower case."""
        if (ids := self.stems.get(low)) is None:
            if (ids := self.stems_before.get(low)) is None:
                ids = self.model_ids(low) if self.direct else self.text_ids(low)
            if len(low) <= LONG:
                if len(self.stems) >= STEMS:
                    self.stems_before, self.stems = self.stems, {}
                self.stems[low] = ids
        return ids

    def word_ids(self, words: pa.Array) -> pa.Array:
        letters, marks = pc.utf8_rtrim(words, MARKS), pc.utf8_ltrim(words, LETTERS)
        # What is left by one and what is left by the other make up a word only if nothing else is in it.
        plain = pc.equal(pc.add(pc.binary_length(letters), pc.binary_length(marks)), pc.binary_length(words))
        stems, marks = each(self.stem, pc.utf8_lower(pc.if_else(plain, letters, ""))), each(self.whole, pc.if_else(plain, marks, ""))
        ids, other = pc.binary_join_element_wise(stems, marks, pa.scalar(b"", pa.large_binary())), pc.invert(plain)
        return pc.replace_with_mask(ids, other, each(self.whole, words.filter(other)))

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        special = pc.match_substring_regex(texts, self.special).to_pylist() if self.special else [False] * len(texts)
        plain = pc.if_else(pa.array(special), "", texts) if any(special) else texts
        # Only Arrow and Python count the four separators as white space; where they occur, ASCII white space alone splits.
        split = pc.ascii_split_whitespace if pc.any(pc.match_substring_regex(plain, "[\x1c-\x1f]")).as_py() else pc.utf8_split_whitespace
        parts = split(plain)
        words = parts.flatten().dictionary_encode()
        # Taken by the words' places, the ids lie one after the other, those of a text from its first word to the next text's.
        ids = self.word_ids(words.dictionary).take(words.indices)
        data = memoryview(ids.buffers()[2] or b"")
        starts = np.frombuffer(ids.buffers()[1], "<i8")[: len(ids) + 1][parts.offsets.to_numpy()].tolist()
        return [self.text_ids(texts[k].as_py()) if special[k] else bytes(data[a:b]) for k, (a, b) in enumerate(itertools.pairwise(starts))]


def each(ids: Callable[[str], bytes], values: pa.Array) -> pa.Array:
    """The ids of all values; those of equal ones are asked for once."""
    found = values.dictionary_encode()
    return pa.array([*map(ids, found.dictionary.to_numpy(zero_copy_only=False))], pa.large_binary()).take(found.indices)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def together(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ROWS rows and BYTES of text, of one row at least."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False), dtype="i8"), 0
    while at < len(ends):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right"))
        stop = max(at + 1, min(at + ROWS, stop))
        yield whole.slice(at, stop - at)
        at = stop


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes the texts, writes them as shards in folder, and returns the manifest: shard, path, n_docs, n_ids.

    folder is a URI that every executor can write to. The manifest is written beside the shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        code, shard = encoder(tokenizer_path), TaskContext.get().partitionId()
        end, width = np.array([end_id], code.kind).tobytes(), np.dtype(code.kind).itemsize
        name, n_docs, n_ids, at = f"shard-{shard:06d}-{uuid.uuid4().hex}", 0, 0, len(MAGIC)
        out = index = None
        for whole in batches:
            for batch in together(whole):
                if out is None:
                    out, index = store.open_output_stream(f"{root}/{name}"), store.open_output_stream(f"{root}/{name}.idx")
                    out.write(MAGIC)
                records, places = [], []
                for i, ids in zip(batch.column(0).to_pylist(), code.encode(batch.column(1))):
                    record = frame(struct.pack("<qB", NO_ID if i is None else i, width) + ids + end)
                    places.append(struct.pack("<QQ", at, n_ids))
                    records.append(record)
                    n_docs, n_ids, at = n_docs + 1, n_ids + len(ids) // width + 1, at + len(record)
                out.write(b"".join(records))
                index.write(b"".join(places))
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [name], "n_docs": [n_docs], "n_ids": [n_ids]}, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    order = [F.col("doc_id").asc(), F.xxhash64("text")]
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(run, "shard int, path string, n_docs long, n_ids long").write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (as stored, little-endian) and width (bytes per id), checked against the checksums."""
    manifest = spark.read.parquet(f"{folder}/manifest").orderBy("shard").toPandas()  # a row for each shard
    manifest["start"] = manifest["n_ids"].cumsum() - manifest["n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("width", pa.int32())])
        for batch in batches:
            for shard in batch.to_pylist():
                store, root = fs.FileSystem.from_uri(folder)
                with store.open_input_file(f"{root}/{shard['path']}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
                if len(index) != shard["n_docs"]:
                    raise ValueError(f"the index of {shard['path']} is incomplete")
                with store.open_input_file(f"{root}/{shard['path']}") as f:
                    if f.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{shard['path']} isn't a shard file")
                    size = f.size()
                    for k in range(0, len(index), TOGETHER):
                        part = index[k : k + TOGETHER]
                        first, last = int(part[0, 0]), int(index[k + TOGETHER, 0]) if k + TOGETHER < len(index) else size
                        f.seek(first)
                        data, rows = memoryview(f.read(last - first)), []
                        for at, before in part.tolist():
                            payload, _ = unframe(data, at - first)
                            i, width = struct.unpack("<qB", payload[:9])
                            rows.append((None if i == NO_ID else i, shard["start"] + before, payload[9:], width))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    shards = spark.createDataFrame(manifest, "shard int, path string, n_docs long, n_ids long, start long") if len(manifest) else spark.createDataFrame([], "shard int, path string, n_docs long, n_ids long, start long")
    return shards.repartition(max(1, len(manifest)), "shard").mapInArrow(run, "doc_id long, start long, ids binary, width int")


def digests(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, f"<u{w}").astype("<u4") for x, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return records.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes the documents to a new folder of the shared one and returns the digests of what is read back."""
    spark = docs.sparkSession
    folder = scratch(spark, "token-records")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    write_records(docs, folder, tokenizer_path, end_id)
    return digests(read_records(spark, folder))
