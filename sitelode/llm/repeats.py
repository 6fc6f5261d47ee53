"""Repeated byte strings across documents by prefix doubling over sampled positions."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sitelode.llm.arrowtext import mix
from sitelode.llm.common import shuffle_partitions
from sitelode.session import materialize

#: Strings of LENGTH bytes count as repeats. Ranks start at FIRST bytes and double by pairing
#: the ranks at offset LENGTH - FIRST. TMER = FIRST modulo STEP makes the sampling the sparse kind.
LENGTH, STEP = 50, 22
FIRST = LENGTH - STEP + 1
TMER = FIRST % STEP
SLICE_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max
_LAST = np.uint64((1 << (8 * TMER)) - 1)


class Slice:
    """Sampled positions of some texts, joined to one buffer.

    Every string of LENGTH bytes picks one position inside itself by its own bytes
    alone, so equal strings pick the same place. `at` are the picked positions,
    `low` and `high` the first and last string start that picks each one, `doc`
    its text.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.bytes = np.frombuffer(b"".join(texts) + bytes(16), np.uint8)
        # the eight bytes from each place on, read in place and copied once
        self.eight = np.ndarray(len(self.bytes) - 7, "<u8", self.bytes, 0, (1,)).copy()
        total = int(sizes.sum())
        n_starts = total - LENGTH + 1
        self.at = self.low = self.high = self.doc = np.empty(0, np.int64)
        if n_starts <= 0:
            return
        tmers = (self.eight[: total - TMER + 1] & _LAST) * np.uint64(0x9E3779B97F4A7C15)
        # Hash above, place below: the smallest is the lowest hash, the leftmost of equal ones.
        key = (tmers & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(tmers), dtype=np.uint64)
        width, wanted = 1, LENGTH - TMER + 1
        while width * 2 <= wanted:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        key = np.minimum(key[: n_starts], key[wanted - width : wanted - width + n_starts])
        # how far behind its start each string picks: below 2 * STEP
        ahead = (key.astype(np.uint32) - np.arange(n_starts, dtype=np.uint32)).astype(np.uint8)
        ahead -= np.uint8(STEP) * (ahead >= STEP)
        # the last LENGTH - 1 places of a text start no string, so the starts of two texts are never neighbours
        inside = np.ones(n_starts + 2, bool)
        none = (self.ends[:, None] - np.arange(1, LENGTH)).ravel()
        inside[none[(none >= 0) & (none < n_starts)] + 1] = False
        inside[0] = inside[-1] = False
        same = np.zeros(n_starts + 1, bool)
        same[1:-1] = ahead[1:] + np.uint8(1) == ahead[:-1]
        begins = inside[1:-1]
        self.low = np.flatnonzero(begins & ~(inside[:-2] & same[:-1]))
        self.high = np.flatnonzero(begins & ~(inside[2:] & same[1:]))
        self.at = self.low + ahead[self.low]
        self.doc = np.searchsorted(self.ends, self.low, side="right")

    def hashed(self, start: np.ndarray, length: int) -> np.ndarray:
        """Hash of `length` bytes from each start."""
        value = np.full(len(start), np.uint64(length))
        for offset in [*range(0, length - 8, 8), length - 8]:
            value = mix(value + self.eight[start + offset])
        return value

    def rank_first(self) -> np.ndarray:
        return self.hashed(self.at, FIRST)

    def rank_context(self, which: np.ndarray) -> np.ndarray:
        """Hash of all strings that pick a position: from `low` to the end of the string at `high`, and where the position lies in it."""
        low, length = self.low[which], self.high[which] - self.low[which] + LENGTH
        value = mix((length * 64 + (self.at[which] - low)).astype(np.uint64))
        for offset in range(0, LENGTH + STEP, 8):
            left = np.clip(length - offset, 0, 8)
            mask = np.where(left == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1))
            word = self.eight[np.minimum(low + offset, len(self.eight) - 1)] & mask
            value = np.where(left > 0, mix(value + word), value)
        return value

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all strings that pick the given positions, their ranks and texts.

        The rank of LENGTH bytes is that of the pair (rank at the start, rank at offset LENGTH - FIRST).
        """
        count = self.high[which] - self.low[which] + 1
        start = np.repeat(self.low[which], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        rank = mix(self.hashed(start, FIRST) + np.uint64(3) * self.hashed(start + LENGTH - FIRST, FIRST))
        return start, rank, np.repeat(self.doc[which], count)


def lowest(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the smallest id of each."""
    return _extremes(key, ids, np.minimum)


def _extremes(key: np.ndarray, ids: np.ndarray, *kinds: np.ufunc) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the smallest or largest id of each."""
    if not len(key):
        return key, *(ids for _ in kinds)
    order = np.argsort(key)
    key, ids = key[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], *(kind.reduceat(ids, first) for kind in kinds)


def _pack(*columns: np.ndarray) -> bytes:
    """Sorted numbers as differences, others as they are, byte planes apart, so that the shuffle's compression finds the zeros."""
    planes = []
    for number, column in enumerate(columns):
        column = np.ascontiguousarray(column).view(np.uint64)
        column = np.diff(column, prepend=np.uint64(0)) if number == 0 else column
        planes.append(column.view(np.uint8).reshape(-1, 8).T.tobytes())
    return b"".join(planes)


def _unpack(packed: bytes, columns: int) -> list[np.ndarray]:
    if not packed:
        return [np.empty(0, np.uint64)] * columns
    planes = np.frombuffer(packed, np.uint8).reshape(columns, 8, -1)
    found = [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes]
    return [np.cumsum(found[0], dtype=np.uint64), *found[1:]]


class Asked:
    """What a slice knows after the questions answered so far.

    Question 1: which first ranks stand in two texts. Question 2: the smallest id
    with the same context, and whether the rank has other contexts. Question 3: the smallest id
    with the same string, asked only for the smallest holder of each of several contexts.
    """

    def __init__(self, rows: pa.Table, answers: pa.Table):
        ids = pc.fill_null(rows["doc_id"], NO_ID).to_numpy().astype(np.int64)
        self.rows, self.ids = rows, ids
        self.texts = pc.fill_null(rows["text"], "").cast(pa.large_binary()).to_pylist()
        self.slice = Slice(self.texts)
        self.answers = {(r["question"], i): r["packed"] for i, r in enumerate(answers.to_pylist())} if answers is not None else {}

    def answered(self, question: int, columns: int) -> list[np.ndarray]:
        parts = [_unpack(p, columns) for (q, _), p in self.answers.items() if q == question]
        if not parts:
            return [np.empty(0, np.uint64)] * columns
        merged = [np.concatenate(c) for c in zip(*parts)]
        order = np.argsort(merged[0], kind="stable")
        return [c[order] for c in merged]

    def first(self) -> list[np.ndarray]:
        self.rank = self.slice.rank_first()
        return [np.unique(self.rank)]

    def shared(self) -> np.ndarray:
        """Positions whose first rank stands in another text, here or elsewhere."""
        self.rank = self.slice.rank_first()
        key, low, high = _extremes(self.rank, self.ids[self.slice.doc], np.minimum, np.maximum)
        several = (low != high) | _within(key, self.answered(1, 1)[0])
        return np.flatnonzero(_within(self.rank, key[several]))

    def second(self) -> list[np.ndarray]:
        which = self.which = self.shared()
        self.context = mix(self.slice.rank_context(which) + self.rank[which])
        context, low = lowest(self.context, self.ids[self.slice.doc[which]])
        self.known = context, low
        order = np.argsort(self.context, kind="stable")
        rank = self.rank[which][order][np.searchsorted(self.context[order], context)]
        order = np.lexsort((context, rank))
        return [rank[order], context[order], low[order].view(np.uint64)]

    def third(self) -> list[np.ndarray]:
        self.second()
        context, low = self.known
        told, smallest, several = self.answered(2, 3)
        low, more = low.copy(), np.zeros(len(low), bool)
        at = np.searchsorted(context, told)
        low[at] = np.minimum(low[at], smallest.view(np.int64))
        more[at] = several > 0
        own = self.ids[self.slice.doc[self.which]]
        at = np.searchsorted(context, self.context)
        self.whole = self.which[low[at] < own]
        starts, rank, doc = self.slice.strings(self.which[(low[at] >= own) & more[at]])
        self.edges = starts, rank, self.ids[doc]
        return list(_as_words(lowest(rank, self.ids[doc])))

    def removed(self) -> np.ndarray:
        """Mask of the bytes covered by a string that also starts in a text of a smaller id."""
        rank, low = self.third()
        low = low.view(np.int64).copy()
        told, smallest = self.answered(3, 2)
        at = np.searchsorted(rank, told)
        low[at] = np.minimum(low[at], smallest.view(np.int64))
        starts, own_rank, own = self.edges
        starts = starts[low[np.searchsorted(rank, own_rank)] < own] if len(starts) else starts
        change = np.zeros(len(self.slice.bytes) + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + LENGTH, -1)
        np.add.at(change, self.slice.low[self.whole], 1)
        np.add.at(change, self.slice.high[self.whole] + LENGTH, -1)
        return np.cumsum(change)[: len(self.slice.bytes)] > 0


def _as_words(columns):
    return (np.ascontiguousarray(c).view(np.uint64) for c in columns)


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


QUESTION_TYPE = "bucket int, slice int, question int, packed binary"
ANSWER_TYPE = "slice int, question int, packed binary"
_QUESTION_SCHEMA = pa.schema([("bucket", pa.int32()), ("slice", pa.int32()), ("question", pa.int32()), ("packed", pa.binary())])
_ANSWER_SCHEMA = pa.schema([("slice", pa.int32()), ("question", pa.int32()), ("packed", pa.binary())])


def _questions(number: int, columns: list[np.ndarray], slice_no: int, buckets: int) -> pa.Table:
    """Cut a question by ranges of its first column, the rank, into buckets."""
    edges = [(b << 64) // buckets for b in range(1, buckets)]
    cuts = [0, *np.searchsorted(columns[0], np.array(edges, dtype=np.uint64)).tolist(), len(columns[0])]
    rows = [
        {"bucket": b, "slice": slice_no, "question": number, "packed": _pack(*(c[lo:hi] for c in columns))}
        for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo
    ]
    return pa.Table.from_pylist(rows, schema=_QUESTION_SCHEMA)


def _answers(asked: pa.Table) -> pa.Table:
    """Answer one bucket: rerank its sorted rows, keep what is not unique, and tell each slice what it could not know."""
    rows = asked.to_pylist()
    number = rows[0]["question"]
    parts = [_unpack(r["packed"], {1: 1, 2: 3, 3: 2}[number]) for r in rows]
    source = np.repeat(np.arange(len(rows)), [len(p[0]) for p in parts])
    columns = [np.concatenate(c) for c in zip(*parts)]
    if number == 1:
        _, back, count = np.unique(columns[0], return_inverse=True, return_counts=True)
        tell, reply = count[back] > 1, [columns[0]]
    else:
        ids = columns[-1].view(np.int64)
        key = columns[0] if number == 3 else columns[1]
        distinct, low = lowest(key, ids)
        smallest = low[np.searchsorted(distinct, key)]
        if number == 3:
            tell, reply = smallest < ids, [key, smallest.view(np.uint64)]
        else:
            order = np.lexsort((key, columns[0]))
            rank, context = columns[0][order], key[order]
            new = np.concatenate([[True], (rank[1:] != rank[:-1]) | (context[1:] != context[:-1])])
            ranks, count = np.unique(rank[new], return_counts=True)
            several = count[np.searchsorted(ranks, columns[0])] > 1
            tell, reply = (smallest < ids) | several, [key, smallest.view(np.uint64), several.astype(np.uint64)]
    out = []
    for i, row in enumerate(rows):
        mine = np.flatnonzero(tell & (source == i)) if len(rows) < 32 else None
        if mine is None:
            first = np.searchsorted(source, i)
            last = np.searchsorted(source, i, side="right")
            mine = first + np.flatnonzero(tell[first:last])
        if len(mine):
            mine = mine[np.argsort(reply[0][mine], kind="stable")]
            out.append({"slice": row["slice"], "question": number, "packed": _pack(*(c[mine] for c in reply))})
    return pa.Table.from_pylist(out, schema=_ANSWER_SCHEMA)


def remove_repeats(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", slice_bytes: int = SLICE_BYTES, with_text: bool = False) -> DataFrame:
    """Remove each byte covered by a string of 50 bytes that also starts in a text with a smaller id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and the
    remaining bytes as `kept` with `with_text`. Texts are UTF-8 bytes, null is empty; strings never cross texts, and all are
    judged on the input. A text without id counts as larger than all others, texts that share an id do not remove from each other. An empty
    table gives no rows. Other columns are not read. Ids must be integers.

    Prefix doubling with pruning: the first ranks, of 29 bytes, are taken only at sampled positions (about one in
    fifteen; every string of 50 bytes picks one of its own). Positions whose rank is unique leave. The others are
    reranked with the whole context of all strings that pick them, where most repeats end; only
    the edges of repeats are reranked string by string, at length 50, from pairs of ranks at offset 21.
    In each round a slice of texts asks once per distinct rank, so a passage that a third of all texts share is one row per
    slice; the questions are sorted and answered by ranges of ranks, both bounded in bytes whatever the table's size.
    Ranks are 64-bit hashes.

    The slices are written once as a table bucketed by slice, so the rounds shuffle questions and answers but no
    texts; the table is dropped when the result is written.
    """
    source = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total // slice_bytes))
    spark, parts, name = df.sparkSession, shuffle_partitions(df.sparkSession), f"slices_{uuid.uuid4().hex}"
    dealt = source.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)).cast("int"))
    dealt.repartition(parts, "slice").write.bucketBy(parts, "slice").option("compression", "zstd").saveAsTable(name)
    grouped = spark.table(name).groupBy("slice")

    def ask(number: int):
        method = (None, "first", "second", "third")[number]

        def asked(rows: pa.Table, answers: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return _QUESTION_SCHEMA.empty_table()
            return _questions(number, getattr(Asked(rows, answers), method)(), rows["slice"][0].as_py(), slices)

        return asked

    answers = spark.createDataFrame([], ANSWER_TYPE)
    for number in (1, 2, 3):
        questions = grouped.cogroup(answers.groupBy("slice")).applyInArrow(ask(number), QUESTION_TYPE)
        told = questions.groupBy("bucket").applyInArrow(_answers, ANSWER_TYPE)
        answers = answers.unionByName(materialize(told, f"answers-{number}"))
    kept_type = ", kept binary" if with_text else ""

    def finish(rows: pa.Table, told: pa.Table) -> pa.Table:
        asked = Asked(rows, told)
        gone = asked.removed()
        out = {"doc_id": rows["doc_id"].combine_chunks(), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for start, end in zip(asked.slice.starts.tolist(), asked.slice.ends.tolist()):
            mask = gone[start:end]
            kept = asked.slice.bytes[start:end][~mask].tobytes()
            out["n_bytes"].append(end - start)
            out["n_removed"].append(int(mask.sum()))
            out["n_spans"].append(int((mask[1:] & ~mask[:-1]).sum()) + int(len(mask) > 0 and mask[0]))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        return pa.table(out).select(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    done = grouped.cogroup(answers.groupBy("slice")).applyInArrow(
        finish, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{kept_type}"
    )
    result = materialize(done, "without-repeats")
    spark.sql(f"DROP TABLE {name}")
    return result.withColumnRenamed("doc_id", doc_id)
