"""Toxicity: a small convolutional text classifier, trained in numpy and scored in Arrow batches."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sitelode.llm.arrowtext import slices, word_hashes, words
from sitelode.session import materialize

WORD_BUCKETS, PREFIX_BUCKETS, PREFIX_CHARS = 1 << 17, 1 << 16, 4
DIMENSIONS, FILTERS, WIDTHS = 16, 8, (1, 2, 3)
PADS = max(WIDTHS)
THRESHOLD = 0.7
#: Bound of the training sample: labelled documents of each class, lowest hash of the id first.
SAMPLE_ROWS = 3000
STEPS, BATCH, RATE = 900, 32, 0.01
#: One key in so many is never trained on.
CALIBRATION_EVERY = 5
#: Bins of the raw output per unit, and where it is clipped.
BINS, LIMIT = 64, 64
#: Rows of its smaller class after which a language's own cut counts as much as the common one.
HALF_TRUST_ROWS = 20


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word number of each place, word and prefix bucket of each distinct word, offsets of the texts."""
    places, distinct, offsets = words(texts, lower=True)
    word = (word_hashes(distinct) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    heads = pc.utf8_slice_codeunits(distinct, 0, PREFIX_CHARS).dictionary_encode()
    prefix = (word_hashes(heads.dictionary) % np.uint64(PREFIX_BUCKETS)).astype(np.int64)[heads.indices.to_numpy()]
    return places, word, prefix, offsets


def padded(places: np.ndarray, offsets: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places with pads after each text, first place of each text, and where no filter may start.

    A filter starts at a word or at the first pad, so no window sees two texts and an empty text has a window.
    """
    long = np.insert(places, np.repeat(offsets[1:], PADS), pad)
    starts = offsets[:-1] + PADS * np.arange(len(offsets) - 1)
    ends = offsets[1:] + PADS * np.arange(len(offsets) - 1)
    return long, starts, (ends[:, None] + np.arange(1, PADS)).ravel()


def _pooled(outputs: list[np.ndarray], starts: np.ndarray, barred: np.ndarray) -> np.ndarray:
    """Sum of the shifted outputs of one filter width, its largest value in each text."""
    total = outputs[0].copy()
    for shift, output in enumerate(outputs[1:], 1):
        total[:-shift] += output[shift:]
    total[barred] = -np.inf
    return np.maximum.reduceat(total, starts, axis=0)


@dataclass
class ToxicityModel:
    """Weights, the point of the raw output that scores `THRESHOLD`, and thresholds by language."""

    word: np.ndarray
    prefix: np.ndarray
    filters: list[np.ndarray]  # per width: width x DIMENSIONS x FILTERS
    filter_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    centre: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def raw(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.empty(0)
        places, word, prefix, offsets = buckets(texts)
        # Filter outputs of every distinct word once; the pad's are zero.
        rows = np.vstack([self.word[word] + self.prefix[prefix], np.zeros((1, DIMENSIONS), np.float32)])
        long, starts, barred = padded(places, offsets, len(word))
        pooled = [
            _pooled([(rows @ shifted)[long] for shifted in filters], starts, barred) for filters in self.filters
        ]
        features = np.maximum(np.hstack(pooled) + self.filter_bias, 0)
        return features.astype(np.float64) @ self.out + self.out_bias

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.shown(self.raw(texts))

    def shown(self, raw: np.ndarray) -> np.ndarray:
        shifted = raw - self.centre + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(shifted, -60, 60)))


def train(
    places: np.ndarray, word: np.ndarray, prefix: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, seed: int = 7
) -> ToxicityModel:
    """Fit on some texts, given as by `buckets`; centre and thresholds are left to `calibrate`.

    Embeddings and filters start small and random; one dimension starts as the
    smoothed log-odds of its bucket, so that rare labels train fast.
    """
    rng = np.random.default_rng(seed)
    model = ToxicityModel(
        (rng.standard_normal((WORD_BUCKETS, DIMENSIONS)) * 0.05).astype(np.float32),
        (rng.standard_normal((PREFIX_BUCKETS, DIMENSIONS)) * 0.05).astype(np.float32),
        [(rng.standard_normal((w, DIMENSIONS, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(FILTERS * len(WIDTHS), 0.2), -1.0,
    )
    if toxic.sum() == 0 or toxic.sum() == len(toxic):
        model.out[:] = 0
        model.out_bias = -4.0 if toxic.sum() == 0 else 4.0
        return model
    owner = np.repeat(np.arange(len(toxic)), np.diff(offsets))
    for table, codes, size in ((model.word, word[places], WORD_BUCKETS), (model.prefix, prefix[places], PREFIX_BUCKETS)):
        seen = np.unique(owner * size + codes)
        doc, code = seen // size, seen % size
        share = [(np.bincount(code[toxic[doc] == v], minlength=size) + 0.5) / ((toxic == v).sum() + 1) for v in (1, 0)]
        table[:, 0] = np.clip(np.log(share[0] / share[1]), -1, 3) * 0.3
    for filters in model.filters:
        filters[0, 0, :] = np.abs(filters[0, 0, :]) + 0.3
    _fit(model, places, word, prefix, offsets, toxic, np.arange(len(toxic)), rng)
    return model


def calibrate(model: ToxicityModel, labels: DataFrame, docs: DataFrame) -> None:
    """Set the centre and the thresholds by language from all labelled rows.

    `labels` has (_key, _label, _seen), `docs` (_key, _text, _lang). All documents are scored where they are read, and
    only key, language and bin of the raw output are shuffled. The counts by language, class and bin are summed in Spark.
    The rows not trained on stand for their whole class, so that class shares are those of all labels.
    A language's cut is drawn towards the common one, by n / (n + HALF_TRUST_ROWS) of the way for n rows of its smaller class
    outside the training; so few rows move it little, and no number of rows switches it on.
    """
    schema = docs.select("_key", "_lang").schema.add("_bin", "integer")

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays(
                    [piece.column("_key"), piece.column("_lang"), pa.array(raw_bins(model.raw(piece.column("_text"))))], names=["_key", "_lang", "_bin"]
                )

    known = labels.groupBy("_key", "_label", "_seen").agg(F.count("*").alias("_n"))
    found = docs.filter(F.col("_key").isNotNull()).select("_key", "_lang", "_text").mapInArrow(binned, schema).join(known, "_key")
    counts = materialize(found.groupBy("_lang", "_label", "_seen", "_bin").agg(F.sum("_n").alias("_n")), "raw-counts")
    everything = Counts(counts.groupBy("_label", "_seen", "_bin").agg(F.sum("_n").alias("_n")).toArrow())
    if min(everything.used) == 0:
        return
    model.centre = everything.cut()
    number = [F.sum(F.when((F.col("_label") == v) & ~F.col("_seen"), F.col("_n")).otherwise(0)) for v in (0, 1)]
    both = counts.groupBy("_lang").agg(F.least(*number).alias("_least")).filter(F.col("_least") > 0)
    spoken = counts.join(both, "_lang").toArrow()
    for language in sorted(pc.unique(spoken["_lang"]).to_pylist()):
        mine = spoken.filter(pc.equal(spoken["_lang"], language))
        trust = mine["_least"][0].as_py() / (mine["_least"][0].as_py() + HALF_TRUST_ROWS)
        cut = Counts(mine).cut(model.centre)
        shrunk = model.centre + trust * (cut - model.centre)
        model.thresholds[language] = THRESHOLD if cut == model.centre else float(model.shown(np.array([shrunk]))[0])


def raw_bins(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(raw * BINS), -LIMIT * BINS, LIMIT * BINS).astype(np.int32)


class Counts:
    """Weight of each bin for both classes: the rows not trained on (all, where there are none), raised to the size of the class."""

    def __init__(self, counts: pa.Table):
        at = counts["_bin"].to_numpy().astype(np.int64) + LIMIT * BINS
        label, n = counts["_label"].to_numpy(), counts["_n"].to_numpy().astype(np.float64)
        seen = counts["_seen"].to_numpy().astype(bool)
        self.weights, self.used = [], []
        for v in (0, 1):
            mine = label == v
            chosen = mine & ~seen if (mine & ~seen).any() else mine
            held = np.bincount(at[chosen], weights=n[chosen], minlength=2 * LIMIT * BINS + 1)
            self.used.append(held.sum())
            self.weights.append(held * (n[mine].sum() / max(held.sum(), 1)))

    def cut(self, wanted: float | None = None) -> float:
        """The cut with the best F1, `wanted` if it parts the bins alike; between two bins it is the middle of the gap."""
        both = self.weights[0] + self.weights[1]
        filled = np.flatnonzero(both)[::-1]
        hits = np.cumsum(self.weights[1][filled])
        best = int(np.argmax(2 * hits / (np.cumsum(both[filled]) + hits[-1])))
        high = filled[best] / BINS - LIMIT
        low = (filled[best + 1] + 1) / BINS - LIMIT if best + 1 < len(filled) else high - 1
        return wanted if wanted is not None and low <= wanted <= high else float((high + low) / 2)


def _fit(model, places, word, prefix, offsets, toxic, chosen, rng) -> None:
    """Adam on random batches, half of each class; only pooled places get a gradient."""
    tables, moments = [model.word, model.prefix], {}
    classes = [chosen[toxic[chosen] == v] for v in (0, 1)]
    zero = np.zeros((1, DIMENSIONS), np.float32)
    coded = [np.append(codes, 0) for codes in (word, prefix)]

    def adam(name, values, gradient, step, rows=None):
        m, v = moments.setdefault(name, (np.zeros_like(values), np.zeros_like(values)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * gradient
        v[at] = 0.999 * v[at] + 0.001 * gradient**2
        values[at] -= RATE * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.999**step)) + 1e-8)

    for step in range(1, STEPS + 1):
        docs = np.concatenate([rng.choice(c, BATCH // 2) for c in classes])
        pieces = [places[offsets[d] : offsets[d + 1]] for d in docs]
        ends = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        long, starts, barred = padded(np.concatenate(pieces), ends, len(word))
        word_at, prefix_at = (codes[long] for codes in coded)
        real = (long < len(word))[:, None]
        x = np.where(real, model.word[word_at] + model.prefix[prefix_at], zero)
        pooled, where = [], []
        for filters in model.filters:
            total = x @ filters[0]
            for shift in range(1, len(filters)):
                total[:-shift] += (x @ filters[shift])[shift:]
            total[barred] = -np.inf
            top = np.maximum.reduceat(total, starts, axis=0)
            owner = np.repeat(np.arange(len(docs)), np.diff(np.append(starts, len(long))))
            index = np.where(total == top[owner], np.arange(len(long))[:, None], len(long))
            pooled.append(top)
            where.append(np.minimum.reduceat(index, starts, axis=0))
        before = np.hstack(pooled) + model.filter_bias
        features = np.maximum(before, 0)
        output = features @ model.out + model.out_bias
        error = (1 / (1 + np.exp(-np.clip(output, -60, 60))) - toxic[docs]) / len(docs)
        into = np.where(before > 0, error[:, None] * model.out, 0).astype(np.float32)
        spread = np.zeros_like(x)
        for number, (filters, at) in enumerate(zip(model.filters, where)):
            part = into[:, number * FILTERS : (number + 1) * FILTERS]
            gradient = np.zeros_like(filters)
            for shift in range(len(filters)):
                for k in range(FILTERS):
                    gradient[shift, :, k] = part[:, k] @ x[at[:, k] + shift]
                    np.add.at(spread, at[:, k] + shift, part[:, k, None] * filters[shift, :, k])
            adam(f"filters{number}", filters, gradient, step)
        touched = np.flatnonzero(spread.any(axis=1) & real[:, 0])
        for name, values, codes in (("word", tables[0], word_at), ("prefix", tables[1], prefix_at)):
            rows, back = np.unique(codes[touched], return_inverse=True)
            summed = np.zeros((len(rows), DIMENSIONS), np.float32)
            np.add.at(summed, back, spread[touched])
            adam(name, values, summed, step, rows)
        adam("bias", model.filter_bias, into.sum(axis=0), step)
        adam("out", model.out, features.T @ error + 1e-4 * model.out, step)
        model.out_bias -= RATE * error.sum() * 4


#: A sampled text: the order and tie of its key, and what `_coded` makes of it.
SAMPLE = pa.schema(
    [("_order", pa.int64()), ("_label", pa.int32()), ("_tie", pa.int64())] + [(n, pa.list_(pa.int32())) for n in ("_places", "_word", "_prefix")]
)


def _coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as the number of the distinct word at each place, and word and prefix bucket of its distinct words."""
    for batch in batches:
        for piece in slices(batch, "_text"):
            places, word, prefix, offsets = buckets(piece.column("_text"))
            lists = []
            for low, high in zip(offsets[:-1], offsets[1:]):
                own, inside = np.unique(places[low:high], return_inverse=True)
                lists.append((inside, word[own], prefix[own]))
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in ("_order", "_label", "_tie")), *(pa.array([x[i] for x in lists], pa.list_(pa.int32())) for i in range(3))],
                names=["_order", "_label", "_tie", "_places", "_word", "_prefix"],
            )


def _train_in_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sample, bounded by its rows, in; the weights as named arrays out."""
    model = _train_table(pa.Table.from_batches(list(batches), SAMPLE))
    named = {"word": model.word, "prefix": model.prefix, "bias": model.filter_bias, "out": model.out, "out_bias": np.array([model.out_bias])}
    named |= {f"filters{i}": values for i, values in enumerate(model.filters)}
    packed = []
    for values in named.values():
        np.save(file := io.BytesIO(), values)
        packed.append(file.getvalue())
    yield pa.RecordBatch.from_arrays([pa.array(list(named)), pa.array(packed, pa.binary())], names=["name", "data"])


def _train_table(sample: pa.Table) -> ToxicityModel:
    sample = sample.take(np.lexsort([sample[c].to_numpy() for c in ("_tie", "_label", "_order")])).combine_chunks()
    toxic = sample["_label"].to_numpy().astype(np.int64)
    word, prefix = (pc.list_flatten(sample[c]).to_numpy().astype(np.int64) for c in ("_word", "_prefix"))
    lengths, distinct = (pc.list_value_length(sample[c]).to_numpy().astype(np.int64) for c in ("_places", "_word"))
    places = pc.list_flatten(sample["_places"]).to_numpy().astype(np.int64) + np.repeat(np.cumsum(distinct) - distinct, lengths)
    return train(places, word, prefix, np.concatenate([[0], np.cumsum(lengths)]), toxic)


def _trained(sample: DataFrame) -> ToxicityModel:
    """Train in one task on the written sample; about 13 MB of weights come back."""
    rows = sample.coalesce(1).mapInArrow(_train_in_task, "name string, data binary").toArrow().to_pylist()
    if not rows:  # no file, no task
        return _train_table(SAMPLE.empty_table())
    named = {r["name"]: np.load(io.BytesIO(r["data"])) for r in rows}
    return ToxicityModel(
        named["word"], named["prefix"], [named[f"filters{i}"] for i in range(len(WIDTHS))], named["bias"], named["out"], float(named["out_bias"][0])
    )


def fit_sample(
    labels: DataFrame, docs: DataFrame, *, label: str = "toxic", text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS
) -> ToxicityModel:
    """Train on a bounded sample of labelled rows, then set the thresholds from all of them.

    The sample is at most `rows` documents of each class, by the hash of `key`, from four fifths of the keys (from all,
    if these lack a class); documents that repeat a key count each. The sampled keys, at most twice `rows`, are broadcast
    to find their texts. Texts stay in their tasks: bucket numbers of the sampled ones, 4 bytes a word and 8 a distinct
    word of a text, are written, one task trains on them, and the weights are all that reaches the driver. See `calibrate` for the thresholds.
    Labels other than 0 and 1, null keys and labels without a text are left out; a null text is an empty one.
    Without texts of both classes the model scores all texts alike.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"), F.xxhash64(key).alias("_order"),
        (F.pmod(F.hash(key), F.lit(CALIBRATION_EVERY)) != 0).alias("_open"),
    )
    found = docs.select(
        F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.col(lang), F.lit("")).alias("_lang")
    )
    for open_only in (True, False):
        part = known.filter("_open") if open_only else known
        taken = [part.filter(F.col("_label") == v).orderBy("_order", "_key").limit(rows) for v in (1, 0)]
        chosen = F.broadcast(taken[0].unionByName(taken[1]))
        coded = found.join(chosen, "_key").select("_order", "_label", F.xxhash64("_text").alias("_tie"), "_text").mapInArrow(
            _coded, "_order bigint, _label int, _tie bigint, _places array<int>, _word array<int>, _prefix array<int>"
        )
        kept = [coded.filter(F.col("_label") == v).orderBy("_order", "_tie").limit(rows) for v in (1, 0)]
        sample = materialize(kept[0].unionByName(kept[1]), "toxicity-sample")
        last = {r["_label"]: r["last"] for r in sample.groupBy("_label").agg(F.max("_order").alias("last")).collect()}
        if len(last) == 2:
            break
    model = _trained(sample)
    if len(last) == 2:
        seen = F.col("_order") <= F.when(F.col("_label") == 1, last[1]).otherwise(last[0])
        calibrate(model, known.withColumn("_seen", seen & F.col("_open") if open_only else seen), found)
    return model


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """Add score, threshold (of the language, else the common one) and toxic (score >= threshold).

    The score depends on the whole text alone; the language only picks the
    threshold. Null and empty texts are scored as empty. All rows are kept, and all columns but former
    ones of these three names, which are replaced. Texts are scored in slices of
    bounded bytes in the tasks that read them; nothing is shuffled.
    """
    docs = docs.drop("score", "threshold", "toxic")
    schema = docs.select("*").schema.add("score", "double").add("threshold", "double").add("toxic", "boolean")

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text):
                value = model.score(piece.column(text))
                limit = np.array([model.thresholds.get(x, THRESHOLD) for x in piece.column(lang).to_pylist()], dtype=np.float64)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(value), pa.array(limit), pa.array(value >= limit)],
                    names=[*piece.schema.names, "score", "threshold", "toxic"],
                )

    return docs.mapInArrow(scored, schema)
