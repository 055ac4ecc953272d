"""Token ids in files of shuffled planes with a chunk index."""

from __future__ import annotations

import io
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, running_before, shared_folder
from .tokens import batches, encoder

MAGIC = b"PLANES01"
#: Ids in a block, the unit that is transposed and compressed.
BLOCK = 1 << 16
LEVEL = 3


def shuffled(ids: np.ndarray, bits: bool) -> list[bytes]:
    """uint32 ids -> their 4 byte planes, or 32 bit planes."""
    rows = ids.astype("<u4").view(np.uint8).reshape(len(ids), 4)
    if bits:
        return [p.tobytes() for p in np.packbits(np.unpackbits(rows, axis=1).T, axis=1)]
    return [p.tobytes() for p in np.ascontiguousarray(rows.T)]


def unshuffled(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 32:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes])
        rows = np.packbits(np.ascontiguousarray(bits.T), axis=1)
    else:
        rows = np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes]).T)
    return rows.reshape(-1).view("<u4")


class Writer:
    """One file: magic, blocks of compressed planes, chunk index, document index, footer.

    The chunk index holds, per block, its ids, its place and the length of each plane; the document index, per
    document, its doc_id, whether it has one, and its number of ids. The footer tells where both stand.
    """

    def __init__(self, out, bits: bool = False):
        import zstandard

        self.out, self.bits, self.pack = out, bits, zstandard.ZstdCompressor(level=LEVEL)
        self.left = bytearray()
        self.chunks: list[tuple] = []
        self.docs: list[tuple] = []
        self.at = self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((0 if doc_id is None else doc_id, doc_id is not None, len(ids) // 4))
        self.left += ids
        while len(self.left) >= BLOCK * 4:
            self._block(bytes(self.left[: BLOCK * 4]))
            del self.left[: BLOCK * 4]

    def _block(self, ids: bytes) -> None:
        planes = [self.pack.compress(p) for p in shuffled(np.frombuffer(ids, "<u4"), self.bits)]
        self.chunks.append((len(ids) // 4, self.at, *map(len, planes)))
        self.at += self._put(b"".join(planes))

    def close(self) -> None:
        if self.left:
            self._block(bytes(self.left))
        chunks = self.pack.compress(np.array(self.chunks, "<i8").tobytes())
        docs = self.pack.compress(np.array(self.docs, "<i8").reshape(-1, 3).T.tobytes())
        self._put(chunks + docs + struct.pack("<5q", self.at, len(chunks), len(docs), 32 if self.bits else 4, len(self.docs)) + MAGIC)


def read_documents(source):
    """(doc_id, start in this file, ids) for each document of an open file, block by block."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    end = source.seek(0, io.SEEK_END)
    source.seek(end - 48)
    footer = source.read(48)
    if footer[40:] != MAGIC:
        raise ValueError("not a file of planes, or cut off")
    at, n_chunks, n_docs, planes, docs = struct.unpack("<5q", footer[:40])
    source.seek(at)
    chunks = np.frombuffer(unpack.decompress(source.read(n_chunks)), "<i8").reshape(-1, 2 + planes)
    ids_of, known, lengths = np.frombuffer(unpack.decompress(source.read(n_docs)), "<i8").reshape(3, docs)
    held: list[np.ndarray] = []
    have = start = 0
    blocks = iter(chunks)
    for doc_id, is_known, n in zip(ids_of.tolist(), known.tolist(), lengths.tolist()):
        while have < n:
            chunk = next(blocks).tolist()
            source.seek(chunk[1])
            data = source.read(sum(chunk[2:]))
            cuts = np.cumsum([0, *chunk[2:]])
            held.append(unshuffled([unpack.decompress(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], chunk[0]))
            have += chunk[0]
        whole = held[0] if len(held) == 1 else np.concatenate(held) if held else np.zeros(0, "<u4")
        yield doc_id if is_known else None, start, whole[:n]
        held, have, start = [whole[n:]], have - n, start + n


def filesystem(uri: str):
    """pyarrow's file system and path of a Hadoop-style uri."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri if ":" in uri else "file://" + uri)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, bits: bool = False) -> None:
    """Encodes docs (doc_id, text), appends end_id to each, and writes files of planes in ascending doc_id order.

    Documents are range-partitioned and sorted by doc_id (null first, ties by text); each task encodes its range
    and writes one file under a name of its own. The folder's manifest, which Spark commits, names the files of
    the attempts that counted, with their places and numbers of ids; others are not read. Null text is
    empty, so each document has end_id at least; an empty table gives an empty manifest.
    """
    ending = struct.pack("<I", end_id)

    def write(rows):
        from pyspark import TaskContext

        out = None
        n = docs_seen = 0
        for pdf in rows:
            for first, texts in batches(pdf["text"].tolist(), 8_000_000):
                for doc_id, ids in zip(pdf["doc_id"].iloc[first : first + len(texts)].tolist(), encoder(tokenizer).encode(texts)):
                    if out is None:
                        fs, base = filesystem(folder)
                        name = f"ids-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.planes"
                        out = fs.open_output_stream(f"{base}/{name}")
                        writer = Writer(out, bits)
                    writer.add(None if pd.isna(doc_id) else int(doc_id), ids + ending)
                    n, docs_seen = n + len(ids) // 4 + 1, docs_seen + 1
        if out is not None:
            writer.close()
            out.close()
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "name": [name], "n_docs": [docs_seen], "n_ids": [n]})

    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInPandas(write, "part long, name string, n_docs long, n_ids long").write.parquet(f"{folder}/manifest.parquet")


def read_ids(spark, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids, or with digest ids_crc32 in their place."""
    manifest = checkpointed(spark.read.parquet(f"{folder}/manifest.parquet").withColumn("block", F.floor(F.col("part") / 1000)))
    files = running_before(manifest, [], "block", ["part"], {"start": "n_ids"}).select("part", "name", "start")
    n_files = max(1, manifest.count())

    def read(rows):
        fs, base = filesystem(folder)
        for pdf in rows:
            for name, begin in zip(pdf["name"], pdf["start"]):
                with fs.open_input_file(f"{base}/{name}") as source:
                    made: list[tuple] = []
                    size = 0
                    for doc_id, start, ids in read_documents(source):
                        made.append((doc_id, int(begin) + start, len(ids), zlib.crc32(ids.tobytes()) if digest else ids))
                        size += 1 if digest else len(ids)
                        if len(made) >= 10_000 or size >= 1_000_000:
                            yield frame(made)
                            made, size = [], 0
                    yield frame(made)

    def frame(made: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(made, columns=["doc_id", "start", "n_tokens", "last"])
        return out.assign(doc_id=out["doc_id"].astype("Int64")).rename(columns={"last": "ids_crc32" if digest else "ids"})

    last = "ids_crc32 long" if digest else "ids array<long>"
    return files.repartition(n_files, "part").mapInPandas(read, f"doc_id long, start long, n_tokens long, {last}")


def op2_byte_planes(spark, sf_dir: str, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """All documents written as ids and read back; null texts are empty and have the end alone."""
    import public_tokenizers

    folder = shared_folder(spark, "ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id)
    return read_ids(spark, folder, digest=True)
