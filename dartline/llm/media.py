"""Media columns: payloads as 8-bit PNG files in tar shards, addressed by what they hold.

A text's payload is its UTF-8 bytes with zeros up to a positive multiple of 64: the rows of a grey picture,
64 samples of 8 bits wide. Every task writes its payloads to tar files of about SHARD bytes in the shared
folder; a member's name is its payload's digest, and a task writes a digest once (while it remembers
it). Over all shards, a digest has one place, the first; rows carry digest, shard, offset and length of
that. A range read of the HEAD bytes at an offset gives the metadata columns and nothing else is read for
them; a range read of the length gives the payload. Both go by slices of shards, so that reading is spread
whatever the size of a shard. No text is shuffled.

Shards are named by task attempt and only told of when closed: an attempt that is lost leaves files that no
row points to. The shared folder must be one that pyarrow opens (local or network folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dartline.llm.common import Work, mapped, table

SHARD = 64 << 20
#: Rows of a shard, and digests that a task remembers, at most.
ROWS, REMEMBERED = 50_000, 200_000
#: A reader's share of a shard.
SLICE = 4 << 20
#: Digests of more than 1 / HOT of all rows (so at most HOT of them) are joined by broadcast.
HOT = 1000
WIDTH = 64
LEVEL = 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and header chunk: length, name, width, height, bits, colour, compression, filter, interlace, crc.
HEADER, HEAD = ">8sI4sIIBBBBBI", 33


def payload_of(text: str | None) -> tuple[bytes, int]:
    body = (text or "").encode("utf-8", "surrogatepass")
    return body + bytes(-len(body) % WIDTH or (0 if body else WIDTH)), len(body)


def chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(samples: bytes) -> bytes:
    """A grey picture of 8 bits, WIDTH wide; the samples are a multiple of that. Rows are not filtered."""
    import numpy as np

    height = len(samples) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, WIDTH)
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0))
    return SIGNATURE + head + chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def read_header(head: bytes) -> dict:
    """width, height, bits and samples of a file by its first HEAD bytes."""
    signature, n, name, width, height, bits, colour, packing, filters, laced, crc = struct.unpack(HEADER, head)
    if (signature, n, name) != (SIGNATURE, 13, b"IHDR") or (bits, colour, packing, filters, laced) != (8, 0, 0, 0, 0) or crc != zlib.crc32(head[12:29]):
        raise ValueError("not a picture of this form")
    return {"width": width, "height": height, "bits": bits, "samples": width * height}


def read_samples(body: bytes) -> bytes:
    """The samples of a whole file of png()."""
    import numpy as np

    meta, at, parts = read_header(body[:HEAD]), HEAD, []
    while at < len(body):
        n, name = struct.unpack(">I4s", body[at : at + 8])
        if struct.unpack(">I", body[at + 8 + n : at + 12 + n])[0] != zlib.crc32(body[at + 4 : at + 8 + n]):
            raise ValueError("a chunk is damaged")
        if name == b"IDAT":
            parts.append(body[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(meta["height"], meta["width"] + 1)
    if rows[:, 0].any():
        raise ValueError("a row is filtered")
    return rows[:, 1:].tobytes()


def opened(folder: str):
    """(file system, path) of a folder given as a path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class Shard:
    """A tar file that is being written and the rows to tell of when it is closed."""

    def __init__(self, files, path: str, name: str):
        self.name, self.at, self.rows, self.stream = name, 0, [], files.open_output_stream(f"{path}/{name}")

    def add(self, name: str, body: bytes) -> tuple[str, int, int]:
        info = tarfile.TarInfo(name)
        info.size = len(body)
        self.stream.write(info.tobuf(tarfile.USTAR_FORMAT) + body + bytes(-len(body) % 512))
        offset = self.at + 512
        self.at = offset + len(body) + -len(body) % 512
        return self.name, offset, len(body)

    def close(self) -> list[dict]:
        self.stream.write(bytes(1024))
        self.stream.close()
        return self.rows


#: Digests are bytes until the end: half of their hexadecimal form in tables and shuffles.
ROW = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"


def pack_shards(docs: DataFrame, folder: str, size: int = SHARD) -> DataFrame:
    """ROW for every row of docs, and the shards in `folder`; kept in the shared folder.

    A null text is the empty text, whose payload is 64 zero bytes. Extra columns are ignored, rows that
    repeat share a member. Empty docs: no shards. A text longer than `size` ends its shard.
    """

    def run(rows):
        from pyspark import TaskContext

        files, path = opened(folder)
        files.create_dir(path, recursive=True)
        context, shard, number, places = TaskContext.get(), None, 0, {}
        for r in rows:
            payload, n = payload_of(r["text"])
            digest = hashlib.sha256(payload).digest()
            if shard is None:
                shard = Shard(files, path, f"{context.partitionId():06d}-{context.taskAttemptId():08d}-{number:06d}.tar")
            if digest not in places:
                if len(places) >= REMEMBERED:
                    places.clear()
                places[digest] = shard.add(f"{digest.hex()}.png", png(payload))
            name, offset, length = places[digest]
            shard.rows.append({"doc_id": r["doc_id"], "n_bytes": n, "digest": digest, "shard": name, "offset": offset, "length": length})
            if shard.at >= size or len(shard.rows) >= ROWS:
                yield from shard.close()
                shard, number = None, number + 1
        if shard is not None:
            yield from shard.close()

    return Work(docs.sparkSession).keep(mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, ROW, size=10_000))


def catalog(rows: DataFrame) -> DataFrame:
    """digest, shard, offset, length: one place for each payload, the first by shard, and the rows that have it.

    A payload of a third of all rows is one row a task before it is shuffled.
    """
    place = F.struct("shard", "offset", "length")
    return rows.groupBy("digest").agg(F.min(place).alias("at"), F.count("*").alias("rows")).select("digest", "at.*", "rows")


def features(samples: bytes) -> str:
    """Mean, peak and crossings of the middle level: integers, so that reruns and machines agree."""
    import numpy as np

    x = np.frombuffer(samples, np.uint8)
    high = x >= 128
    return f"mean={int(x.sum(dtype=np.int64)) // len(x)};peak={int(x.max())};crossings={int((high[1:] != high[:-1]).sum())}"


META = "width int, height int, bits int, samples long"
MEDIA = "payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


def of_places(places: DataFrame, folder: str, payload: bool) -> DataFrame:
    def run(rows):
        files, path = opened(folder)
        name = stream = None
        for r in rows:
            if r["shard"] != name:
                if stream is not None:
                    stream.close()
                name, stream = r["shard"], files.open_input_file(f"{path}/{r['shard']}")
            out = r | read_header(stream.read_at(HEAD, r["offset"]))
            if payload:
                body = stream.read_at(r["length"], r["offset"])
                samples = read_samples(body)
                if hashlib.sha256(samples).digest() != r["digest"]:
                    raise ValueError(f"{name} at {r['offset']} is damaged: the payload read back has another digest")
                out |= {"payload_bytes": len(samples), "tail_crc32": zlib.crc32(samples[-64:]), "media_bytes": len(body), "media_sha256": hashlib.sha256(body).digest(), "feature": features(samples)}
            yield out
        if stream is not None:
            stream.close()

    own = places.select("digest", "shard", "offset", "length", "rows")
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: the few bytes that go in mean many to read
    own = own.repartition(tasks, "shard", F.expr(f"offset div {SLICE}")).sortWithinPartitions("shard", "offset")
    return mapped(own, run, f"digest binary, shard string, offset long, length long, rows long, {META}" + (f", {MEDIA}" if payload else ""))


def read_metadata(places: DataFrame, folder: str) -> DataFrame:
    """places (of catalog) with META, by reads of HEAD bytes each; no payload is read."""
    return of_places(places, folder, False)


def read_media(places: DataFrame, folder: str) -> DataFrame:
    """places with META of the header and what the stored payload says: MEDIA. A payload whose digest isn't its address
    is a ValueError, so the address of a row of the result is the digest of what was read back."""
    return of_places(places, folder, True)


def media_rows(rows: DataFrame, media: DataFrame) -> DataFrame:
    """Each document's row (of pack_shards) with its payload's place, META, MEDIA and payload_sha256; digests in hexadecimal.

    Payloads of many rows are joined by broadcast, by the pigeonhole few; the others by digest.
    """
    total = media.agg(F.sum("rows").alias("n")).first()["n"] or 0
    hot = F.col("rows") * HOT > total
    own = rows.select("doc_id", "n_bytes", "digest")
    few = media.where(hot).drop("rows")
    often = own.join(F.broadcast(few), "digest")
    rest = own.join(F.broadcast(few.select("digest")), "digest", "left_anti").join(media.where(~hot).drop("rows"), "digest")
    hexed = {c: F.lower(F.hex(x)) for c, x in (("digest", "digest"), ("payload_sha256", "digest"), ("media_sha256", "media_sha256"))}
    return often.unionByName(rest).withColumns(hexed)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark)
    folder = f"{work.root}/shards"
    rows = pack_shards(table(spark, sf_dir, "documents"), folder)
    return media_rows(rows, work.keep(read_media(catalog(rows), folder)))
