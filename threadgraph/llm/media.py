"""Media columns: texts as lossless FLAC streams, read back as PCM blocks with seekable sample offsets.

``store`` adds the stored form, ``blocks`` reads stored streams back to one row for each PCM block (sample offset, byte offset
in the stream's frames, PCM bytes), and ``round_trip`` does both in one pass and returns the digests of what was read back.
Batches are worked off in slices of bounded size; there is no shuffle.

Defined results: a null text counts as empty, whose payload is 64 zero bytes; equal texts have equal values in every column
but doc_id; a null doc_id stays null; an empty table gives an empty result; further columns are ignored. A damaged stream
raises FlacError; none is skipped.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

SLICE_BYTES = 1_500_000
LPC = ((1,) * 8, 3)  # linear predictor that is tried beside the fixed ones: the mean of eight samples


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def in_slices(values, size, most: int = SLICE_BYTES):
    start = held = 0
    for k, v in enumerate(values):
        held += size(v)
        if held >= most:
            yield start, values[start : k + 1]
            start, held = k + 1, 0
    if start < len(values):
        yield start, values[start:]


def features(pcm: bytes, n_blocks: int) -> str:
    """Integers only, so that they are the same everywhere: peak, energy and sign changes of the samples, and blocks."""
    import numpy as np

    samples = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    return f"blocks={n_blocks};peak={int(np.abs(samples).max())};energy={int(samples @ samples)};crossings={crossings}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, media (binary): a FLAC stream of each text."""

    def run(batches):
        import pyarrow as pa

        from . import flac

        for batch in batches:
            texts = [payload_of(t) for t in batch.column(1).to_pylist()]
            for start, own in in_slices(texts, len):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(start, len(own)), "media": pa.array(flac.encode(own, lpc=LPC), pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, media binary")


def blocks(stored: DataFrame) -> DataFrame:
    """doc_id, sample_offset, byte_offset, pcm of each block of each stream in ``media``; a null stream has none."""

    def run(batches):
        import pyarrow as pa

        from . import flac

        for batch in batches:
            rows = [(i, m) for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if m is not None]
            for _, own in in_slices(rows, lambda r: len(r[1])):
                found = [(i, b) for (i, _), part in zip(own, flac.decode([m for _, m in own]), strict=True) for b in part]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([i for i, _ in found], pa.int64()),
                        "sample_offset": pa.array([b.sample for _, b in found], pa.int64()),
                        "byte_offset": pa.array([b.offset for _, b in found], pa.int64()),
                        "pcm": pa.array([b.pcm for _, b in found], pa.binary()),
                    }
                )

    picked = stored.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("media").cast("binary").alias("media"))
    return picked.mapInArrow(run, "doc_id long, sample_offset long, byte_offset long, pcm binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """Store each text, read the stored bytes back, and describe what came back."""

    def run(batches):
        import pyarrow as pa

        from . import flac

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, own in in_slices(texts, len):
                media = flac.encode([payload_of(t) for t in own], lpc=LPC)
                rows = []
                for text, stream, part in zip(own, media, flac.decode(media), strict=True):
                    pcm = b"".join(b.pcm for b in part)
                    rows.append((len(text.encode()), len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), features(pcm, len(part))))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(start, len(own))} | {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
