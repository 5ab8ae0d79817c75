"""Token-id files: a wavelet matrix per shard.

A shard's ids are stored as one bit-plane per bit of the largest id.  Plane k
holds bit k of every id, in the order that the planes before have left: zeros
first, then ones.  With counts of ones per block this gives any token, the
number of occurrences of an id before a place, and the place of its n-th
occurrence, straight from the planes.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from perioda.llm.common import as_text, col, ship_package
from perioda.session import new_shared_path

#: Tokens after which a shard is closed, at the end of a document.
SHARD_TOKENS = 1 << 21
#: Text that a worker encodes at once, or one longer text.
SLICE_BYTES = 4 << 20
#: Bits between two stored counts of ones.
BLOCK = 512
MAGIC = b"WVM1"
#: Pieces a Python worker remembers in each of two generations, and the longest one that is.
REMEMBERED_PIECES = 400_000
REMEMBERED_BYTES = 64

FILE_SCHEMA = T.StructType(
    [
        T.StructField("partition", T.IntegerType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("matrix", T.BinaryType()),
    ]
)


class WaveletMatrix:
    """The file format and what it answers.

    Layout, little-endian: magic, tokens (8 bytes), planes (4); then for each
    plane, highest bit first, its number of zeros (8), its bits packed from
    the lowest bit of each byte up to whole blocks, and the ones before each
    block (4 bytes each).
    """

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        self.size, self.levels = struct.unpack_from("<QI", image, 4)
        blocks, at = -(-self.size // BLOCK), 16
        self.zeros, self.planes, self.before = [], [], []
        for _ in range(self.levels):
            self.zeros.append(struct.unpack_from("<Q", image, at)[0])
            self.planes.append(np.frombuffer(image, np.uint8, blocks * BLOCK // 8, at + 8))
            at += 8 + blocks * BLOCK // 8
            self.before.append(np.frombuffer(image, np.uint32, blocks, at))
            at += 4 * blocks

    @staticmethod
    def build(ids: np.ndarray) -> bytes:
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        blocks = -(-len(ids) // BLOCK)
        parts = [MAGIC, struct.pack("<QI", len(ids), levels)]
        order = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        for level in range(levels - 1, -1, -1):
            ones = (order >> level & 1).astype(bool)
            plane = np.zeros(blocks * BLOCK // 8, np.uint8)
            packed = np.packbits(ones, bitorder="little")
            plane[: len(packed)] = packed
            inside = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
            before = np.concatenate([[0], np.cumsum(inside)[:-1]]) if blocks else inside
            parts += [struct.pack("<Q", len(ids) - int(inside.sum())), plane.tobytes(), before.astype(np.uint32).tobytes()]
            order = np.concatenate([order[~ones], order[ones]])
        return b"".join(parts)

    def _bit(self, level: int, place: int) -> int:
        return int(self.planes[level][place >> 3]) >> (place & 7) & 1

    def _ones(self, level: int, place: int) -> int:
        """Ones of a plane before ``place``."""
        block, plane = place // BLOCK, self.planes[level]
        if block == len(self.before[level]):
            return self.size - self.zeros[level]
        start = block * BLOCK >> 3
        found = int(self.before[level][block]) + int(np.bitwise_count(plane[start : place >> 3]).sum())
        return found + (int(plane[place >> 3]) & (1 << (place & 7)) - 1).bit_count()

    def _place(self, level: int, place: int, bit: int) -> int:
        """Where the next plane has what this one has at ``place``."""
        ones = self._ones(level, place)
        return self.zeros[level] + ones if bit else place - ones

    def access(self, place: int) -> int:
        """The token at a place."""
        if not 0 <= place < self.size:
            raise IndexError(place)
        token = 0
        for level in range(self.levels):
            bit = self._bit(level, place)
            token, place = token << 1 | bit, self._place(level, place, bit)
        return token

    def rank(self, token: int, place: int) -> int:
        """Occurrences of a token before a place."""
        if token < 0 or token >> self.levels:
            return 0
        start, end = 0, min(max(place, 0), self.size)
        for level in range(self.levels):
            bit = token >> (self.levels - 1 - level) & 1
            start, end = self._place(level, start, bit), self._place(level, end, bit)
        return end - start

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def _select_bit(self, level: int, bit: int, n: int) -> int:
        """The place of the n-th one or zero of a plane, from 0."""
        low, high = 0, self.size
        while low < high:
            middle = (low + high) // 2
            ones = self._ones(level, middle + 1)
            if (ones if bit else middle + 1 - ones) > n:
                high = middle
            else:
                low = middle + 1
        return low

    def select(self, token: int, n: int) -> int:
        """The place of the n-th occurrence of a token, from 0."""
        if not 0 <= n < self.count(token):
            raise IndexError(n)
        place = 0
        bits = [token >> (self.levels - 1 - level) & 1 for level in range(self.levels)]
        for level, bit in enumerate(bits):
            place = self._place(level, place, bit)
        place += n
        for level in range(self.levels - 1, -1, -1):
            n = place - self.zeros[level] if bits[level] else place
            place = self._select_bit(level, bits[level], n)
        return place

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, n) for n in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All tokens, from the last plane back to the first."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        order = np.zeros(self.size, kind)
        for level in range(self.levels - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.size, bitorder="little").astype(bool)
            zeros, back = self.zeros[level], np.empty_like(order)
            back[~ones] = order[:zeros]
            back[ones] = order[zeros:] | kind(1 << (self.levels - 1 - level))
            order = back
        return order.astype(np.uint32)


#: A word that ends in an ASCII letter, and ASCII marks other than an apostrophe behind it: between the two
#: there is always a border.
_WORD_AND_MARKS = re.compile(rb"(?s)([a-z\x80-\xff]*[a-z])([!-&(-/:-@\[-`{-~].*)")
#: Letters below this are lower-cased alike in every library and have no other normal form; one is not.
_PLAIN_LETTERS, _DOTTED_I = "ƀ", "İ"


def byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in byte-level vocabularies: itself if it can be seen, else the next free one."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PieceIds(dict):
    """White-space piece of a text (UTF-8, A-Z lower-cased) -> its ids as little-endian 32-bit numbers.

    The tokenizer drops white space and lets no token cross it, and ASCII
    white space is white space to it, so a text's ids are those of its pieces.
    Pieces seen lately are remembered in two generations: when the younger one
    is full it takes the place of the older one.
    """

    def __init__(self, definition: str):
        super().__init__()
        self.tokenizer = tokenizers.Tokenizer.from_str(definition)
        self.model, self.older, self.letters = self.tokenizer.model, {}, byte_letters()

    def __missing__(self, piece: bytes) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            parts = _WORD_AND_MARKS.fullmatch(piece)
            if parts and b"<|" not in piece:
                packed = self[parts[1]] + self[parts[2]]
            else:
                ids = self.encoded(piece)
                packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def encoded(self, piece: bytes) -> list[int]:
        """The library's ids; a word of plain letters is its own normal form and one word, so it goes to the model."""
        text = piece.decode()
        if text.isalpha() and max(text) < _PLAIN_LETTERS and _DOTTED_I not in text:
            word = text.lower().encode().decode("latin-1").translate(self.letters)
            return [token.id for token in self.model.tokenize(word)]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, places where each text ends).

        Equal pieces are looked up once; their ids are then laid out in the order of the texts.
        """
        # Special strings are found before letters are lower-cased, and letters are composed with their marks before:
        # some have a composed form as small letters only.  Marks that letters are composed with start with these bytes.
        special = pc.match_substring(texts, "<|")
        for lead in (b"\xcc", b"\xcd"):
            special = pc.or_(special, pc.match_substring(texts.cast(pa.binary()), lead))
        split = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))
        words = split.flatten().cast(pa.binary()).dictionary_encode()
        packed = list(map(self.__getitem__, words.dictionary.to_pylist()))
        ids = np.frombuffer(b"".join(packed), "<u4")
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        order = words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[order])])
        places = np.repeat(starts[order] - ends[:-1], sizes[order])
        places += np.arange(len(places))
        borders = split.offsets.to_numpy() - split.offsets[0].as_py()
        return ids[places], ends[borders[1:]]


_LOADED: dict[str, PieceIds] = {}


def crosses_no_white_space(definition: str) -> bool:
    """True if a tokenizer can be applied to white-space pieces one by one.

    Shown on its parts: words are cut by a pattern that no white space
    matches, and normal forms are those that work within words.
    """
    parts = json.loads(definition)
    steps = (parts["normalizer"] or {}).get("normalizers", [parts["normalizer"]])
    known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    splits = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
    first = splits[0] if splits else {}
    words = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    own = first.get("pattern", {}).get("Regex", "")
    plain = all(
        not t["lstrip"] and not t["rstrip"] and t["content"].startswith("<|") and not set(t["content"]) & set(" \t\n\r\x0b\x0c")
        for t in parts["added_tokens"]
    )
    return steps == known and words and own.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and plain


def _slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes, or one longer text."""
    total, start = 0, 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        total += size
        if total >= limit:
            yield start, i + 1
            total, start = 0, i + 1
    if start < len(texts):
        yield start, len(texts)


def _encoded(definition: str, by_piece: bool, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = PieceIds(definition)
    pieces = _LOADED[key]
    if by_piece:
        return pieces.of_texts(texts)
    ids = [pieces.tokenizer.encode(text, add_special_tokens=False).ids for text in texts.to_pylist()]
    return np.concatenate([np.zeros(0, np.uint32), *map(np.uint32, ids)]), np.cumsum([len(own) for own in ids])


class _Shard:
    """What has been gathered for the matrix that comes next."""

    def __init__(self, task: int):
        self.task, self.part, self.size = task, 0, 0
        self.ids: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.names: list[pa.Array] = []

    def add(self, names: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        self.names.append(names)
        self.ids.append(ids)
        self.ends.append(ends + self.size)
        self.size += len(ids)

    def closed(self) -> pa.RecordBatch:
        matrix = WaveletMatrix.build(np.concatenate(self.ids))
        names, ends = pa.concat_arrays(self.names).to_pylist(), np.concatenate(self.ends).tolist()
        row = [[self.task], [self.part], [self.size], [names], [ends], [matrix]]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        columns = [pa.array(value, kind) for value, kind in zip(row, kinds)]
        self.part, self.size, self.ids, self.ends, self.names = self.part + 1, 0, [], [], []
        return pa.RecordBatch.from_arrays(columns, names=FILE_SCHEMA.fieldNames())


def write_files(
    docs: DataFrame,
    tokenizer_path: str,
    path: str,
    *,
    end_id: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode texts, an end id behind each, and write them as wavelet matrices ascending by doc_id, null first.

    Rows are range partitioned; equal ids are ordered by a hash of their
    texts.  A task closes a matrix whenever it is full, so no task or file
    grows with the table.  A file's row holds one matrix with the ids and ends
    of its documents; Spark's committer puts files in place, so a task that is
    run again leaves one copy.
    """
    ship_package(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    by_piece = crosses_no_white_space(definition)
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    slice_bytes = min(SLICE_BYTES, 4 * shard_tokens)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(TaskContext.get().partitionId())
        for batch in batches:
            for start, end in _slices(batch.column(1), slice_bytes):
                ids, ends = _encoded(shared.value, by_piece, batch.column(1)[start:end])
                ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
                shard.add(batch.column(0)[start:end], ids, ends)
                if shard.size >= shard_tokens:
                    yield shard.closed()
        if shard.size:
            yield shard.closed()

    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), as_text(text).alias("text"))
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(packed, FILE_SCHEMA).write.parquet(path)


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """For each matrix the number of tokens in all before it, as ``start``."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = files.select("partition", "part", "n_tokens")
    # Partitions first, then the parts of each: no window sees all files.
    whole = sizes.groupBy("partition").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(F.col("partition").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("partition").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    starts = sizes.join(whole, F.col("partition") == F.col("p"))
    return starts.select("partition", "part", (F.col("base") + F.col("inner")).alias("start"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for partition, part, _, names, ends, matrix in zip(*(column for column in batch.columns)):
            ids = WaveletMatrix(matrix.as_py()).ids().astype("<u4")
            stops = ends.as_py()
            starts = [0, *stops[:-1]]
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, stops)]
            n = len(stops)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([partition.as_py()] * n, pa.int32()),
                    pa.array([part.as_py()] * n, pa.int32()),
                    pa.array(names.as_py(), pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array([b - a for a, b in zip(starts, stops)], pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["partition", "part", "doc_id", "inner", "n_tokens", "ids_crc32"],
            )


def documents_in(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    ship_package(spark)
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    schema = "partition int, part int, doc_id long, inner long, n_tokens long, ids_crc32 long"
    rows = files.mapInArrow(_read, schema)
    starts = file_starts(spark, path)
    joined = rows.join(starts, ["partition", "part"])
    return joined.select("doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(
    docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", path: str | None = None
) -> DataFrame:
    """Encode, write, and read back; see ``documents_in`` for the columns.

    One row per row; a null text is empty and has the end id alone; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    path = path or new_shared_path(spark, "wavelet")
    write_files(docs, tokenizer_path, path, end_id=end_id, doc_id=doc_id, text=text)
    return documents_in(spark, path)
