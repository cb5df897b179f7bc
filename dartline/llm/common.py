"""What the operators of this subpackage share: tables, the shared folder, word hashes, packed arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dartline.plans.work import Work, shared_dir  # noqa: F401

#: Word of most operators: a run of anything but the six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Distinct words whose hashes a worker remembers at a time.
REMEMBERED = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of the columns has, whatever the case of its letters."""
    return "_" * (1 + max((len(c) for c in columns), default=0)) + name


def crc_fold(doc_id, n: int):
    """crc32 of doc_id as text, modulo n; null: null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


class WordHashes(dict):
    """Word bytes -> 64-bit hash, forgetting all when full (bounded memory)."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; a null text has none."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(*arrays: np.ndarray) -> bytes:
    """Integer or float arrays as one compressed value; sorted unsigned arrays are best passed as differences."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        kind, width = a.dtype.str.encode(), a.dtype.itemsize
        if a.dtype.kind == "u" and len(a):  # bytes that are 0 in all numbers are left out
            width = max(1, -(-int(a.max()).bit_length() // 8))
        if a.dtype.itemsize > 1:  # byte planes: high bytes of small numbers are zeros side by side
            planes, whole = np.empty((width, len(a)), np.uint8), a.view(np.uint8).reshape(-1, a.dtype.itemsize)
            for k in range(width):  # one at a time, which is much quicker than a transposed copy
                planes[k] = whole[:, k]
            body = planes.tobytes()
        else:
            body = a.tobytes()
        parts.append(bytes([len(kind)]) + kind + bytes([width]) + len(a).to_bytes(8, "little") + body)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(value: bytes) -> list[np.ndarray]:
    body, out, at = zstandard.ZstdDecompressor().decompress(bytes(value)), [], 0
    while at < len(body):
        k = body[at]
        dtype, width = np.dtype(body[at + 1 : at + 1 + k].decode()), body[at + 1 + k]
        n = int.from_bytes(body[at + 2 + k : at + 10 + k], "little")
        at += 10 + k
        raw = np.frombuffer(body, np.uint8, n * width, at)
        at += n * width
        if dtype.itemsize > 1:
            whole = np.zeros((n, dtype.itemsize), np.uint8)
            for k in range(width):
                whole[:, k] = raw[k * n : (k + 1) * n]
            raw = whole.reshape(-1)
        out.append(raw.view(dtype))
    return out


def ordered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 on in ascending order, and where each stood. Equal numbers come in the order they had."""
    bits = len(values).bit_length()
    if len(values) and int(values.max()).bit_length() + bits < 64:  # one sort of numbers with their places is the quickest
        both = np.sort(values << bits | np.arange(len(values)))
        return both >> bits, both & ((1 << bits) - 1)
    order = np.argsort(values, kind="stable")
    return values[order], order


def deltas(a: np.ndarray) -> np.ndarray:
    """Differences of a sorted unsigned array, the first from 0; undone by cumsum."""
    return np.diff(a, prepend=a.dtype.type(0))


def undeltas(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=a.dtype)


def rows_of(batches: Iterator, most: int = 64) -> Iterator[dict]:
    """Rows as dicts, a few of them Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield from batch.slice(start, most).to_pylist()


def groups(batches: Iterator, key: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Arrow batches whose rows are sorted by key -> (key, rows) of one group at a time."""
    now, rows = None, []
    for row in rows_of(batches):
        k = tuple(row[c] for c in key)
        if k != now:
            if rows:
                yield now, rows
            now, rows = k, []
        rows.append(row)
    if rows:
        yield now, rows


def grouped(df: DataFrame, key: list[str], fn: Callable[[tuple, list[dict]], Iterator[dict]], schema: str, size: int = 512) -> DataFrame:
    """fn over the rows of each key, one group in memory at a time; yields dicts of schema's columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    def run(batches):
        yield from batched((out for k, rows in groups(batches, key) for out in fn(k, rows)), arrow, size)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def mapped(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str, size: int = 512) -> DataFrame:
    """fn over the rows of each partition as dicts; yields dicts of schema's columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    def run(batches):
        yield from batched(fn(rows_of(batches)), arrow, size)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def batched(rows: Iterator[dict], schema, size: int, most: int = 8 << 20) -> Iterator:
    """Rows as Arrow batches of at most `size` rows and about `most` bytes of binary values."""
    import pyarrow as pa

    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row.values() if isinstance(v, (bytes, str)))
        if len(held) >= size or weight >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def row_slices(batches: Iterator, most: int = 1 << 21) -> Iterator[dict[str, list]]:
    """Arrow batches as column lists whose `text` values hold about `most` bytes together, or one row."""
    return (batch.to_pydict() for batch in text_slices(batches, most))


def text_slices(batches: Iterator, most: int) -> Iterator:
    """Arrow batches whose `text` values hold about `most` bytes together, or one row."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            held += size
            if held >= most or i + 1 == len(sizes):
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0


def hash_texts(texts: list, hashes: WordHashes, split: Callable = words_of) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and the number of words of each; the words of one text at a time."""
    parts = []
    for text in texts:
        words = split(text)
        parts.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), lengths


#: Words without ASCII punctuation: A-Z lower-cased, and all but letters, digits and non-ASCII bytes a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).split() if text else []


def segment_ids(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(lengths)), lengths)
