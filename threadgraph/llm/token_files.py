"""Token ids in binary files of fixed-width packed blocks.

Texts are range-partitioned and sorted by doc_id, encoded by their task, and written in that order: a file holds a range of
documents, and files in order of their number hold all. A file is

* blocks of ``BLOCK_IDS`` ids, each id in the bits that the vocabulary's largest needs, least significant bit first; the last block is
  shorter; a line feed after each block, which keeps blocks apart and is no part of them;
* a footer: doc_id of each document (signed 64-bit), whether it is null (8-bit), its number of ids (64-bit), offset of each block and of
  the footer (64-bit), CRC-32 of each block (32-bit), then file number, bits, ids of a block, ids, documents, blocks and the footer's
  length (64-bit), and ``MAGIC``; all unsigned unless stated, little-endian.

Every block starts at a whole byte, so ``TokenFile`` reads any span of ids from the footer and the blocks it lies in, and unpacks
them with numpy. Files are written by Spark's text writer, whose rows are bytes here, under its commit protocol: a task that fails
or runs twice leaves one file. They can lie in any store that Spark writes to.

Encoding equals the ``tokenizers`` library's: a chunk between white space is encoded once by a worker and remembered (in two bounded
generations). Chunks of letters of the first two Unicode blocks are cut by the tokenizer's pattern and merged by the library's model;
all others, and those that may hold a special token, are encoded by the library as they are. Special tokens in texts are read as such,
as the library does. A tokenizer of another make is applied to whole texts.

Defined results: a null text counts as empty; an empty text is its end id alone; whole texts of any length are encoded; rows without
doc_id come first; rows that share a doc_id are ordered by their text's hash, and equal rows anyhow; an empty table gives no files
and an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shared_path, table, text_or_empty
from .hashing import give_back

MAGIC = b"idbits01"
TAIL = struct.Struct("<7Q8s")
BLOCK_IDS = 4_096  # a multiple of 8, so that blocks of any width fill whole bytes
FILE_BYTES = 32 << 20  # of text
END_ID = 2
MEMO_CHUNKS = 400_000
LONGEST_CHUNK = 64
MOST_FILES = 1_000_000  # numbers and starts of so many files, 16 MB, may be broadcast

# What the fast way takes for a tokenizer, and its pattern over lower-case text of the first two Unicode blocks.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\\s{LETTERS}{DIGITS}]+")
OTHER = re.compile("[^\x00-\u017f]|[\u0130\x1c-\x1f]|<\\|")
NO_SPACE = re.compile("[\x1c-\x1f]")  # white space to Python, but not to the tokenizer
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")



def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else more))
        more += b not in printable
    return out


class Encoder:
    """Ids of whole texts as bytes of unsigned integers, 16 bits each if the vocabulary allows, else 32."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        own = json.loads(tokenizer_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.code = "H" if self.vocabulary <= 1 << 16 else "I"
        self.letters = byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.fast = self._known(own)

    @staticmethod
    def _known(own: dict) -> bool:
        normal = [x.get("type") for x in (own.get("normalizer") or {}).get("normalizers", [])]
        before = (own.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        splits = before[0].get("pattern") == {"Regex": SPLIT} and [x.get("type") for x in before[1:]] == ["ByteLevel"]
        plain = all(x["special"] and x["content"].startswith("<|") and not x["lstrip"] and not x["rstrip"] for x in own["added_tokens"])
        return normal == NORMALIZERS and splits and plain and not own.get("post_processor")

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self.old[1].get(piece)
            if found is None:
                mapped = piece if piece.isascii() and piece.isprintable() else "".join(map(self.letters.__getitem__, piece.encode()))
                found = self._packed([x.id for x in self.library.model.tokenize(mapped)])
            if len(piece) <= LONGEST_CHUNK:
                self.pieces[piece] = found
        return found

    def chunk(self, chunk: str) -> bytes:
        """A chunk without white space. Most are a word, or a word and a mark."""
        if chunk.isascii():
            low = chunk.lower()
            if low.isalpha():
                return self.piece(low)
            if low[:-1].isalpha() and not low[-1].isdigit():
                return self.piece(low[:-1]) + self.piece(low[-1])
        if OTHER.search(chunk):
            return self._packed(self.library.encode(chunk, add_special_tokens=False).ids)
        return b"".join(map(self.piece, PIECES.findall(chunk.lower())))

    def text(self, text: str) -> bytes:
        if not self.fast:
            return self._packed(self.library.encode(text, add_special_tokens=False).ids)
        chunks = (SPACE.split(text.strip(" ")) if NO_SPACE.search(text) else text.split()) if text else []
        known, old = self.chunks, self.old[0]
        found = list(map(known.get, chunks))
        if None in found:
            for k, x in enumerate(chunks):
                if found[k] is None:
                    own = known.get(x)
                    if own is None:
                        own = old.get(x)
                        if own is None:
                            own = self.chunk(x)
                        if len(x) <= LONGEST_CHUNK:
                            known[x] = own
                    found[k] = own
        out = b"".join(found)
        if len(known) > MEMO_CHUNKS or len(self.pieces) > MEMO_CHUNKS:
            self.old, self.chunks, self.pieces = (known, self.pieces), {}, {}
        return out


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in so many bits, least significant first."""
    if bits % 8 == 0:
        return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : bits // 8]).tobytes()
    each = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits % 8 == 0:
        out = np.zeros((count, 4), np.uint8)
        out[:, : bits // 8] = np.frombuffer(data, np.uint8, count * bits // 8).reshape(count, -1)
        return out.view("<u4").ravel()
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return each @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Writer:
    """Rows of a file: blocks as they fill, then the footer. Ids come as bytes of little-endian integers of so many ``octets``."""

    def __init__(self, number: int, bits: int, octets: int):
        self.number, self.bits, self.octets = number, bits, octets
        self.open: list[bytes] = []
        self.held = self.at = 0
        self.docs, self.nulls, self.counts, self.offsets, self.sums = array("q"), bytearray(), array("Q"), array("Q"), array("I")

    def _block(self, ids: bytes) -> bytes:
        row = ids if self.bits == 8 * self.octets else pack(np.frombuffer(ids, f"<u{self.octets}"), self.bits)
        self.offsets.append(self.at)
        self.sums.append(zlib.crc32(row))
        self.at += len(row) + 1
        return row

    def add(self, doc_id: int | None, ids: bytes):
        """The rows of the blocks that are full now."""
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids) // self.octets)
        self.open.append(ids)
        self.held += len(ids)
        size = BLOCK_IDS * self.octets
        if self.held < size:
            return []
        whole = b"".join(self.open)
        end = len(whole) - len(whole) % size
        self.open, self.held = [whole[end:]], len(whole) - end
        return [self._block(whole[k : k + size]) for k in range(0, end, size)]

    def close(self) -> list[bytes]:
        last = [self._block(b"".join(self.open))] if self.held else []
        self.offsets.append(self.at)
        body = b"".join((self.docs.tobytes(), bytes(self.nulls), self.counts.tobytes(), self.offsets.tobytes(), self.sums.tobytes()))
        return [*last, body + TAIL.pack(self.number, self.bits, BLOCK_IDS, sum(self.counts), len(self.docs), len(self.sums), len(body) + TAIL.size, MAGIC)]


class TokenFile:
    """Random access to the ids of a file; ``source`` is a seekable binary stream, of which only what is asked for is read."""

    def __init__(self, source):
        self.source = source
        source.seek(-TAIL.size - 1, io.SEEK_END)
        self.number, self.bits, self.block_ids, self.n_ids, n_docs, n_blocks, length, magic = TAIL.unpack(source.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        source.seek(-length - 1, io.SEEK_END)
        body = source.read(length - TAIL.size)
        places = np.cumsum([0, 8 * n_docs, n_docs, 8 * n_docs, 8 * (n_blocks + 1), 4 * n_blocks])
        part = [body[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
        self.doc_ids, self.nulls = np.frombuffer(part[0], "<i8"), np.frombuffer(part[1], np.bool_)
        self.starts = np.concatenate(([0], np.cumsum(np.frombuffer(part[2], "<u8")))).astype(np.int64)
        self.offsets, self.sums = np.frombuffer(part[3], "<u8"), np.frombuffer(part[4], "<u4")

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of whole blocks, first to last (not included)."""
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last] - self.offsets[first]))
        out = []
        for k in range(first, last):
            row = data[int(self.offsets[k] - self.offsets[first]) : int(self.offsets[k + 1] - self.offsets[first]) - 1]
            if zlib.crc32(row) != self.sums[k]:
                raise ValueError(f"block {k} of file {self.number} is damaged")
            out.append(unpack(row, self.bits, min(self.block_ids, self.n_ids - k * self.block_ids)))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file, by the blocks they lie in."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first = start // self.block_ids
        return self.blocks(first, -(-stop // self.block_ids))[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, place: int) -> np.ndarray:
        return self.ids(int(self.starts[place]), int(self.starts[place + 1]))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> int:
    """Write the ids of all texts to files under ``path``; ``tokenizer``: a tokenizer file, read by the driver. Returns how many files."""
    with open(tokenizer, encoding="utf-8") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())  # a tokenizer file: its size doesn't depend on the corpus
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // file_bytes), min(docs.sparkSession.sparkContext.defaultParallelism, size >> 20))

    def run(batches):
        import pyarrow as pa

        own = encoder(model.value)
        bits = max(1, (max(own.vocabulary - 1, end_id)).bit_length())
        octets, writer = array(own.code).itemsize, None
        end = end_id.to_bytes(octets, "little")
        for batch in batches:
            rows = []
            for number, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                writer = writer or Writer(number, bits, octets)
                rows += writer.add(doc_id, own.text(text.as_py()) + end)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array(writer.close(), pa.binary())], ["value"])
        give_back()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    picked = picked.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("doc_id").asc_nulls_first(), "h", "place"]
    dealt = picked.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = dealt.select(F.spark_partition_id().alias("number"), "doc_id", "text").mapInArrow(run, "value binary")
    # The cast keeps bytes as they are, whatever they are.
    rows.select(F.col("value").cast("string")).write.text(path)
    return parts


def read_documents(spark, path: str, files: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file of each document, read from the files."""

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "file", "place", "n_tokens", "ids_crc32"]
        for batch in batches:
            for content in batch.column(0):
                own = TokenFile(pa.BufferReader(content.as_buffer()))
                ids = own.blocks(0, len(own.sums)).astype("<u4").tobytes()
                at = (4 * own.starts).tolist()
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.doc_ids, mask=own.nulls), pa.array(np.full(len(sums), own.number, np.int64)), pa.array(own.starts[:-1]), pa.array(np.diff(own.starts)), pa.array(sums, pa.int64())], names
                )
        give_back()

    found = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    rows = materialise(found.mapInArrow(run, "doc_id long, file long, place long, n_tokens long, ids_crc32 long"), "token-documents")
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = sizes.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = rows.join(F.broadcast(starts) if files <= MOST_FILES else starts, "file")
    return joined.select("doc_id", (F.col("_before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "file")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "token-files")
    files = write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, path, files)
