"""Token ids in wavelet matrices: succinct bit-planes with rank and select, one per shard."""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sitelode.llm.arrowtext import slices, words
from sitelode.llm.common import shuffle_partitions

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SHARD_TOKENS = 1 << 20
BLOCK = 512
CACHED_WORDS = 1_200_000
#: A sign set between words that are encoded together, and how many are.
BETWEEN, TOGETHER = "\x01", 64
#: What a token that ends a word ends with, in vocabularies of whole words.
WORD_END = "</w>"
#: Texts by which a tokenizer shows whether a text's ids are those of its words.
PROBES = (
    "The quick brown Fox. It's 3.14, a_b-c!", "  Tab\there\n\nnew  line.\r\n ", "x. A1. don't, 'll", "NA\u00cfVE \u00fcber. Stra\u00dfe,", "", " ",
    "<b>bold</b> www.a.b/c?d=1,", "12,000.50. e.g. U.S.A.", "\u4e2d\u6587 \U0001f600. \u0416\u0436,",
)


class WaveletMatrix:
    """A sequence of ids as one bit-plane per bit, highest first; each plane lists zeros before ones of the plane above.

    `ranks` holds the ones before every block of 512 bits, so a rank needs one
    entry and the bits of one block.
    """

    def __init__(self, length: int, planes: list[bytes], ranks: list[bytes]):
        self.length, self.levels = length, len(planes)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]
        self.zeros = [length - int(self._ones_before(level, np.array([length]))[0]) for level in range(self.levels)]

    @staticmethod
    def build(ids: np.ndarray, levels: int) -> tuple[list[bytes], list[bytes]]:
        planes, ranks = [], []
        now = ids
        for level in range(levels):
            ones = (now >> (levels - 1 - level)) & 1 == 1
            planes.append(np.packbits(ones, bitorder="little").tobytes())
            per_block = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK), dtype=np.uint32) if len(ones) else []
            ranks.append(np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32).tobytes())
            now = np.concatenate([now[~ones], now[ones]])
        return planes, ranks

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 3] >> (at & 7)) & 1

    def _ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at // BLOCK
        ones = self.ranks[level][block].astype(np.int64)
        first, width = block * (BLOCK // 8), BLOCK // 8
        spread = first[:, None] + np.arange(width)
        plane = self.planes[level]
        raw = np.where(spread < len(plane), plane[np.minimum(spread, max(0, len(plane) - 1))], 0) if len(plane) else np.zeros_like(spread, np.uint8)
        bits = np.unpackbits(raw.astype(np.uint8), axis=1, bitorder="little")
        return ones + (bits * (np.arange(BLOCK) < (at - block * BLOCK)[:, None])).sum(axis=1, dtype=np.int64)

    def access(self, at) -> np.ndarray:
        """Ids at the given places."""
        at = np.asarray(at, dtype=np.int64)
        ids = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            bit, ones = self._bit(level, at).astype(np.int64), self._ones_before(level, at)
            ids = ids << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return ids

    def _range(self, value: int, start: int, stop: int) -> tuple[int, int]:
        at = np.array([start, stop], dtype=np.int64)
        for level in range(self.levels):
            ones = self._ones_before(level, at)
            at = self.zeros[level] + ones if value >> (self.levels - 1 - level) & 1 else at - ones
        return int(at[0]), int(at[1])

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """How often an id stands in [start, stop)."""
        if value >> self.levels or value < 0:
            return 0
        first, last = self._range(value, start, self.length if stop is None else stop)
        return last - first

    def occurrences(self, value: int) -> np.ndarray:
        """All places of an id, ascending: select, from the lowest plane up."""
        if value >> self.levels or value < 0:
            return np.empty(0, np.int64)
        at = np.arange(*self._range(value, 0, self.length))
        for level in reversed(range(self.levels)):
            one = value >> (self.levels - 1 - level) & 1
            at = self.select(level, one, at - (self.zeros[level] if one else 0))
        return at

    def select(self, level: int, bit: int, number: np.ndarray) -> np.ndarray:
        """Places of the bits of a plane with the given numbers, counted from 0 among the ones or zeros.

        The block of each is found by binary search in `ranks`, its place inside by counting the bits of that block, so a look-up
        costs the same in a long plane as in a short one. Where more bits are asked for than there are blocks, the plane is unpacked once instead.
        """
        number = np.asarray(number, dtype=np.int64)
        if len(number) > len(self.ranks[level]):
            bits = np.unpackbits(self.planes[level], bitorder="little")[: self.length]
            return np.flatnonzero(bits == bit)[number]
        before = self.ranks[level].astype(np.int64)
        before = before if bit else np.minimum(np.arange(len(before)) * BLOCK, self.length) - before
        block = np.searchsorted(before, number, side="right") - 1
        width, plane = BLOCK // 8, self.planes[level]
        spread = (block * width)[:, None] + np.arange(width)
        raw = np.where(spread < len(plane), plane[np.minimum(spread, len(plane) - 1)], 0) if len(number) else np.zeros((0, width))
        bits = np.unpackbits(raw.astype(np.uint8), axis=1, bitorder="little") == bit
        inside = (np.cumsum(bits, axis=1) <= (number - before[block])[:, None]).sum(axis=1)
        return block * BLOCK + inside

    def decode(self) -> np.ndarray:
        """All ids in order: the stable partitions undone from the lowest plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.length, kind)
        for level in reversed(range(self.levels)):
            ones = np.unpackbits(self.planes[level], bitorder="little")[: self.length].view(bool)
            above = np.empty_like(now)
            above[~ones] = now[: self.zeros[level]]
            above[ones] = now[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            now = above
        return now


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_encoder(path: str, end_id: int) -> WordEncoder | TextEncoder:
    """The encoder of this worker process: tasks that follow each other keep its words.

    It is kept in a module of its own name, which lives as long as the process does; this module's code travels with each task.
    A tokenizer whose ids of the probes are not those of their words encodes whole texts.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tokenizers

    kept = vars(sys.modules.setdefault("sitelode_kept_encoders", ModuleType("sitelode_kept_encoders")))
    if (path, end_id) not in kept:
        tokenizer = tokenizers.Tokenizer.from_file(path)
        whole, probes = TextEncoder(tokenizer, end_id), pa.array(PROBES)
        by_words = WordEncoder(tokenizer, end_id)
        same = all(np.array_equal(x, y) for x, y in zip(whole(probes), by_words(probes)))
        kept[path, end_id] = by_words if same else whole
    return kept[path, end_id]


def _strings(array: pa.Array) -> list[str]:
    """Texts without nulls as Python strings, faster than value by value."""
    return array.to_numpy(zero_copy_only=False).tolist()


class TextEncoder:
    """Ids of whole texts, for any tokenizer."""

    def __init__(self, tokenizer, end_id: int):
        self.encode, self.end_id = tokenizer.encode_batch, end_id

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text, the end id included."""
        coded = [e.ids for e in self.encode([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        lengths = np.fromiter((len(c) + 1 for c in coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable((*c, self.end_id) for c in coded), np.uint32, int(lengths.sum()))
        return flat, lengths


class WordEncoder:
    """Ids of whole texts through the ids of their words.

    For a tokenizer that drops white space, lower-cases and separates letters from
    other signs, the ids of a text are the ids of its words in order, and a final
    stop or comma after a letter or digit is a word of its own. So each distinct
    word is encoded once. All words are forgotten when there are too many; that
    costs time, not results.
    """

    END, NOTHING = 0, 1

    def __init__(self, tokenizer, end_id: int):
        self.encode, self.end_id = tokenizer.encode_batch, end_id
        sign = tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.between = sign[0] if len(sign) == 1 else None
        # ids that end a word, in vocabularies that tell; runs of letters are one such word each
        vocabulary = tokenizer.get_vocab()
        self.ending = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ending[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat, self.lengths, self.starts = np.array([self.end_id], np.uint32), np.array([1, 0], np.int32), np.array([0, 1], np.int32)

    def _add(self, new: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        self.numbers.update(zip(new, range(len(self.lengths), len(self.lengths) + len(new))))
        self.flat, self.lengths = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths.astype(np.int32)])
        self.starts = np.cumsum(self.lengths, dtype=np.int32) - self.lengths

    def _expanded(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known words in a row, and where each word's ids end."""
        counts = self.lengths[numbers]
        ends = np.cumsum(counts, dtype=np.int64)
        shifts = np.repeat((self.starts[numbers] - (ends - counts)).astype(np.int32), counts)
        shifts += np.arange(len(shifts), dtype=np.int32)
        return self.flat[shifts], ends

    def _together(self, new: list[str], between: str) -> np.ndarray:
        joined = [between.join([*new[i : i + TOGETHER], ""]) for i in range(0, len(new), TOGETHER)]
        return np.fromiter(chain.from_iterable(e.ids for e in self.encode(joined, add_special_tokens=False)), np.uint32)

    def _letters(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words that are runs of letters: many in one text, each up to the id that ends a word."""
        flat = self._together(new, " ")
        closing = np.flatnonzero(self.ending[flat])
        if len(closing) == len(new) and (not len(flat) or closing[-1] == len(flat) - 1):
            return flat, np.diff(closing, prepend=-1)
        return self._encoded(new)

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words: many in one text with a sign between them, whose id no other word has; one by one where a word has it."""
        if self.between is not None:
            flat = self._together(new, f" {BETWEEN} ")
            closing = np.flatnonzero(flat == self.between)
            if len(closing) == len(new):
                return flat[flat != self.between], np.diff(closing, prepend=-1) - 1
        coded = [e.ids for e in self.encode(new, add_special_tokens=False)]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.uint32, int(lengths.sum())), lengths

    def _learn(self, words_now: list[str]) -> None:
        given = pa.array(words_now, pa.large_string())
        ended = pc.match_substring_regex(given, "[A-Za-z0-9][.,]$")
        cut = pc.if_else(ended, pc.utf8_slice_codeunits(given, 0, -1), given)
        foldable = pc.and_(pc.string_is_ascii(given), pc.invert(pc.match_substring(given, "<")))
        stem = pc.if_else(foldable, pc.ascii_lower(cut), cut)
        other = pc.not_equal(stem, given)
        plain, whole, stems = (_strings(a) for a in (given.filter(pc.invert(other)), given.filter(other), stem.filter(other)))
        tails = [w[-1] if e else "" for w, e in zip(whole, ended.filter(other).to_numpy(zero_copy_only=False).tolist())]
        new = [w for w in dict.fromkeys([*plain, *stems, ".", ","]) if w not in self.numbers]
        letters = [w for w in new if w.isalpha() and w.islower()]
        self._add(letters, *self._letters(letters))
        others = [w for w in new if not (w.isalpha() and w.islower())]
        self._add(others, *self._encoded(others))
        if whole:
            pairs = np.empty(2 * len(whole), np.int64)
            pairs[0::2] = [self.numbers[w] for w in stems]
            pairs[1::2] = [self.numbers[t] if t else self.NOTHING for t in tails]
            flat, ends = self._expanded(pairs)
            self._add(whole, flat, np.diff(ends[1::2], prepend=0))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text, the end id included."""
        places, distinct, offsets = words(texts, lower=False)
        known = _strings(distinct)
        if len(self.numbers) + len(known) > CACHED_WORDS:
            self._forget()
        found = list(map(self.numbers.get, known))
        missing = [i for i, n in enumerate(found) if n is None]
        self._learn([known[i] for i in missing])
        for i in missing:
            found[i] = self.numbers[known[i]]
        number = np.array(found, np.int64)
        n_texts = len(offsets) - 1
        closing = offsets[1:] + np.arange(n_texts)
        ended = np.full(len(places) + n_texts, self.END, np.int64)
        inner = np.ones(len(ended), bool)
        inner[closing] = False
        ended[inner] = number[places]
        ids, ends = self._expanded(ended)
        return ids, np.diff(ends[closing], prepend=0)


def _shard_rows(batches: Iterable[pa.RecordBatch], path: str, end_id: int, levels: int, most: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encoder, part, number = text_encoder(path, end_id), TaskContext.get().partitionId(), 0
    held: list[tuple[list, np.ndarray, np.ndarray]] = []

    def close() -> pa.RecordBatch:
        nonlocal number
        ids = np.concatenate([h[1] for h in held])
        if len(ids) and int(ids.max()) >> levels:
            raise ValueError(f"id {ids.max()} does not fit {levels} bits")
        planes, ranks = WaveletMatrix.build(ids.astype(np.uint16) if levels <= 16 else ids, levels)
        row = {
            "part": part, "number": number, "doc_ids": [d for h in held for d in h[0]],
            "lengths": np.concatenate([h[2] for h in held]).tolist(), "n_tokens": len(ids), "planes": planes, "ranks": ranks,
        }
        number += 1
        held.clear()
        return pa.RecordBatch.from_pylist([row], schema=schema)

    total = 0
    for batch in batches:
        for piece in slices(batch):
            ids, lengths = encoder(piece.column("text"))
            held.append((piece.column("doc_id").to_pylist(), ids, lengths))
            total += len(ids)
            if total >= most:
                yield close()
                total = 0
    if held:
        yield close()


def write_tokens(
    docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = END_ID, levels: int = 16,
    shard_tokens: int = SHARD_TOKENS, doc_id: str = "doc_id", text: str = "text",
) -> None:
    """Encode every whole text and write the ids as wavelet matrices, in ascending doc_id order.

    The file format is a folder of Parquet files (zstd), one row per shard: part and number (shards ascend by
    both), doc_ids and lengths (ids of each text, end id included), n_tokens, planes and ranks (see
    `WaveletMatrix`). A shard closes after the slice of texts that fills `shard_tokens`, so it is bounded by
    that, four megabytes of text and one longest text. An empty table writes no shard; null texts have just
    the end id; null ids come first; repeated ids are kept, ordered by text. Other columns are not read.

    Texts are range-partitioned by id first, so that each is encoded once, in the task that writes it. Any tokenizer file of
    the tokenizers library will do; one whose ids of a text are not those of its words encodes whole texts, which takes longer.
    """
    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ranged = chosen.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    where = tokenizer or tokenizer_path()
    schema = pa.schema([
        ("part", pa.int32()), ("number", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
        ("n_tokens", pa.int64()), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
    ])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _shard_rows(batches, where, end_id, levels, shard_tokens, schema)

    shards = ranged.mapInArrow(
        rows, "part int, number int, doc_ids array<bigint>, lengths array<bigint>, n_tokens bigint, planes array<binary>, ranks array<binary>"
    )
    shards.write.option("compression", "zstd").parquet(path)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, dict, WaveletMatrix]]:
    for i in range(batch.num_rows):
        row = {name: batch.column(name)[i].as_py() for name in ("part", "number", "n_tokens", "planes", "ranks")}
        yield i, row, WaveletMatrix(row["n_tokens"], row["planes"], row["ranks"])


def _with_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, number and the ids before each shard. Parts are as many as the writing tasks, a few thousand rows at most."""
    shards = spark.read.parquet(path).select("part", "number", "n_tokens")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_all"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("_here", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select(
        "part", "number", (F.col("_before") + F.col("_here")).alias("_shard_start")
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: doc_id, start (ids of all texts before it), n_tokens, ids_crc32 (little-endian 32-bit ids)."""
    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row, matrix in _matrices(batch):
                ids = matrix.decode().astype("<u4")
                lengths = np.asarray(batch.column("lengths")[i].as_py(), dtype=np.int64)
                ends = np.cumsum(lengths)
                view = memoryview(ids).cast("B") if len(ids) else memoryview(b"")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[i].values,
                        pa.array(np.full(len(lengths), row["part"], np.int32)), pa.array(np.full(len(lengths), row["number"], np.int32)),
                        pa.array(ends - lengths), pa.array(lengths),
                        pa.array([zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())], pa.int64()),
                    ],
                    names=["doc_id", "part", "number", "_offset", "n_tokens", "ids_crc32"],
                )

    rows = spark.read.parquet(path).mapInArrow(
        decoded, "doc_id bigint, part int, number int, _offset bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return rows.join(_with_starts(spark, path), ["part", "number"]).select(
        "doc_id", (F.col("_shard_start") + F.col("_offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_counts(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """How often each of the given ids stands in each shard, by rank alone: part, number, token, n."""
    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, row, matrix in _matrices(batch):
                yield pa.RecordBatch.from_pylist(
                    [{"part": row["part"], "number": row["number"], "token": t, "n": matrix.count(t)} for t in ids],
                    schema=pa.schema([("part", pa.int32()), ("number", pa.int32()), ("token", pa.int64()), ("n", pa.int64())]),
                )

    return spark.read.parquet(path).mapInArrow(counted, "part int, number int, token bigint, n bigint")


def token_places(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Every place of an id in the whole sequence, by select: column place."""
    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, row, matrix in _matrices(batch):
                at = matrix.occurrences(token)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), row[k], np.int32)) for k in ("part", "number")] + [pa.array(at.astype(np.int64))],
                    names=["part", "number", "_at"],
                )

    places = spark.read.parquet(path).mapInArrow(found, "part int, number int, _at bigint")
    return places.join(_with_starts(spark, path), ["part", "number"]).select((F.col("_shard_start") + F.col("_at")).alias("place"))
