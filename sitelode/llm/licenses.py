"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sitelode.llm.arrowtext import slices, words
from sitelode.session import materialize

#: Notices that name a license, by SPDX identifier. Fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
#: Names of files whose license holds for their directory.
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
SIMILARITY = 0.75
#: Lengths of the runs compared with a template, as parts of its own number of words.
RUNS = (0.8, 1.0, 1.2)
#: Runs compared exactly at a time.
RUN_BLOCK = 20000
#: What surrounds words in comments, beyond the marks that every term loses; these words open comment lines.
COMMENT_MARKS, COMMENT_WORDS = "-%|=+~_\\{}$@&`^.,;:!?\"'()[]<>*#/", ("rem", "dnl")


def _terms(texts: pa.Array) -> tuple[np.ndarray, list, np.ndarray]:
    """Lower-case words without punctuation at their ends; a word of punctuation alone stays as an empty term."""
    places, distinct, offsets = words(texts, lower=True)
    return places, pc.utf8_trim(distinct, ".,;:!?\"'()[]<>*#/").to_pylist(), offsets


class Templates:
    """Weighted templates: idf from document counts of all files, unit length."""

    def __init__(self, templates, files: int, counts: dict[str, int]):
        texts = [t for _, t in templates]
        places, distinct, offsets = _terms(pa.array(texts, pa.large_string()))
        self.names = [name for name, _ in templates]
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for t in distinct if t}))}
        self.idf = np.array([np.log((files + 1) / (counts.get(t, 0) + 1)) + 1 for t in sorted(self.vocabulary)])
        self.unknown = np.log(files + 1) + 1
        weights = np.zeros((len(templates), len(self.vocabulary)))
        self.lengths = [sum(bool(distinct[p]) for p in places[offsets[k] : offsets[k + 1]]) for k in range(len(templates))]
        for k in range(len(templates)):
            for p in places[offsets[k] : offsets[k + 1]]:
                if distinct[p]:
                    weights[k, self.vocabulary[distinct[p]]] += 1
        weights *= self.idf
        self.weights = weights / np.sqrt((weights**2).sum(axis=1, keepdims=True))

    def best(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Best template and its cosine for each text; words in no template weigh as the rarest words, each by itself."""
        places, distinct, offsets = _terms(texts)
        code = np.array([self.vocabulary.get(t, -1) if t else -2 for t in distinct], dtype=np.int64)[places]
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        known = code >= 0
        size = len(self.vocabulary)
        pair, times = np.unique(owner[known] * size + code[known], return_counts=True)
        who, term = pair // size, pair % size
        value = times * self.idf[term]
        squares = np.bincount(who, weights=value**2, minlength=len(texts)).astype(np.float64)  # whole numbers when empty
        squares += self.unknown**2 * np.bincount(owner[code == -1], minlength=len(texts))
        top, cosine = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for k, weights in enumerate(self.weights):
            product = np.bincount(who, weights=value * weights[term], minlength=len(texts))
            similar = np.where(squares > 0, product / np.sqrt(np.maximum(squares, 1e-300)), 0.0)
            better = similar > cosine + 1e-12
            top[better], cosine[better] = k, similar[better]
        return top, cosine


    def best_run(self, texts: pa.Array, top: np.ndarray, cosine: np.ndarray, least: float) -> None:
        """Raise `top` and `cosine` where a run of words across lines is closer, and at least `least`, to a template.

        Runs start at every word that the template has too, and have about its length (`RUNS`); at its end a text has
        shorter ones. Comment marks are no words. Prefix sums bound every cosine from above, since the square of a count is
        no less than the count; only runs whose bound reaches `least` are compared exactly.
        """
        places, distinct, offsets = words(texts, lower=True)
        bare = pc.utf8_trim(distinct, COMMENT_MARKS).to_pylist()
        code = np.array([-2 if not t or t in COMMENT_WORDS else self.vocabulary.get(t, -1) for t in bare], dtype=np.int64)[places]
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))[code != -2]
        code = code[code != -2]
        if not (code >= 0).any():
            return
        ends = np.cumsum(np.bincount(owner, minlength=len(texts)))[owner]
        size = len(self.vocabulary)
        squares = np.append(self.idf**2, self.unknown**2)  # code -1 takes the last
        summed = np.concatenate([[0.0], np.cumsum(squares[code])])
        at = np.arange(len(code))
        found = []
        for k, length in enumerate(self.lengths):
            mine = np.append(self.idf * self.weights[k], 0.0)
            product = np.concatenate([[0.0], np.cumsum(mine[code])])
            starts = at[mine[code] > 0]
            for part in RUNS:
                stop = np.minimum(starts + max(1, round(length * part)), ends[starts])
                bound = (product[stop] - product[starts]) / np.sqrt(np.maximum(summed[stop] - summed[starts], 1e-300))
                near = bound >= least - 1e-6
                found.append((starts[near], stop[near], np.full(near.sum(), k), bound[near]))
        start, stop, template, bound = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(-bound, kind="stable")
        for low in range(0, len(order), RUN_BLOCK):
            block = order[low : low + RUN_BLOCK]
            block = block[cosine[owner[start[block]]] < np.minimum(bound[block] + 1e-6, 1 - 1e-9)]
            lengths = stop[block] - start[block]
            run = np.repeat(np.arange(len(block)), lengths)
            inside = np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            term = code[start[block][run] + inside]
            pair, times = np.unique(run[term >= 0] * size + term[term >= 0], return_counts=True)
            value = times * self.idf[pair % size]
            norm = np.bincount(pair // size, weights=value**2, minlength=len(block)).astype(np.float64)
            norm += self.unknown**2 * np.bincount(run[term < 0], minlength=len(block))
            k, who = template[block], owner[start[block]]
            similar = np.bincount(pair // size, weights=value * self.weights[k[pair // size], pair % size], minlength=len(block)) / np.sqrt(norm)
            best = np.lexsort((k, -np.round(similar, 12), who))
            best = best[np.unique(who[best], return_index=True)[1]]
            best = best[similar[best] >= least - 1e-9]
            best = best[similar[best] > cosine[who[best]] + 1e-12]
            top[who[best]], cosine[who[best]] = k[best], similar[best]


def _document_counts(files: DataFrame, terms: set[str]) -> tuple[int, dict[str, int]]:
    """Number of files, and in how many each template term stands."""
    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                places, distinct, offsets = _terms(piece.column("text"))
                wanted = np.array([t in terms for t in distinct], dtype=bool)
                hit = wanted[places] if len(places) else np.empty(0, bool)
                owner = np.repeat(np.arange(piece.num_rows), np.diff(offsets))[hit]
                tally: dict[str, set] = {}
                for t, o in set(zip((distinct[p] for p in places[hit]), owner.tolist())):
                    tally.setdefault(t, set()).add(o)
                listed = [("", piece.num_rows), *((t, len(o)) for t, o in tally.items())]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in listed]), pa.array([n for _, n in listed], pa.int64())], names=["term", "n"])

    rows = files.select("text").mapInArrow(counted, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in rows}
    return counts.pop("", 0), counts


def directory(path: Column) -> Column:
    """The directory of a path; a path without a slash lies in the empty, topmost one."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _ancestors(path: Column) -> Column:
    """All directories at and above one, as structs of depth and name; the topmost is the empty one."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")),
    )


def scan_licenses(
    files: DataFrame, *, path: str = "path", text: str = "text", keep: tuple[str, ...] = (), templates=TEMPLATES, similarity: float = SIMILARITY
) -> DataFrame:
    """The license of every file: path, `keep`, own_license, cosine, license, origin, license_path.

    Every line of the whole text, the whole text itself and runs of words across lines (`Templates.best_run`, counted
    where they reach `similarity`) are compared with the templates by TF-IDF cosine; `own_license` is the best template at or above `similarity` (the
    first of equal ones), `cosine` the best value. A file named like a license gives its own license to its directory (of several, the highest
    cosine, then the smallest path). A file without an own license inherits from the nearest directory at or above its
    own; `origin` is own, inherited or null, `license_path` the file the license comes from.
    Null and empty texts have cosine 0; a null path has no directory and inherits nothing; paths are compared without leading or doubled slashes.
    Repeated rows are all kept. An empty table gives no rows. Columns beyond `keep` are not read.

    The document counts are those of the template terms over all files, a few hundred numbers. Only distinct
    directories are resolved, by an equi-join of their ancestors with the directories that have a license.
    """
    source = files.select(F.col(path).alias("path"), *keep, F.col(text).alias("text"))
    _, distinct, _ = _terms(pa.array([t for _, t in templates], pa.large_string()))
    known = Templates(templates, *_document_counts(source, {t for t in distinct if t}))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                texts = pc.fill_null(piece.column("text").cast(pa.large_string()), "").take(pa.array(np.arange(piece.num_rows)))
                lines = pc.split_pattern_regex(texts, r"[\r\n]+")
                line_top, line_cosine = known.best(lines.flatten())
                top, cosine = known.best(texts)
                owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
                order = np.lexsort((line_top, -line_cosine, owner))
                first = np.unique(owner[order], return_index=True)
                best_line = order[first[1]]
                better = line_cosine[best_line] > cosine[first[0]]
                at = first[0][better]
                top[at], cosine[at] = line_top[best_line][better], line_cosine[best_line][better]
                known.best_run(texts, top, cosine, similarity)
                names = [known.names[k] if c >= similarity else None for k, c in zip(top, np.round(cosine, 9))]
                kept = [piece.column(c) for c in ("path", *keep)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(names, pa.string()), pa.array(np.round(cosine, 9))], names=["path", *keep, "own_license", "cosine"]
                )

    kept_type = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    own = materialize(source.mapInArrow(scored, f"{kept_type}, own_license string, cosine double"), "own-licenses")
    placed = own.withColumn("_dir", F.array_join(F.filter(F.split(directory(F.col("path")), "/"), lambda x: x != ""), "/"))
    given = (
        placed.filter(F.col("own_license").isNotNull() & F.col("path").rlike(LICENSE_FILE))
        .groupBy(F.col("_dir").alias("above"))
        .agg(F.min_by(F.struct("own_license", "path"), F.struct(-F.col("cosine"), F.col("path"))).alias("from"))
    )
    wanted = placed.filter(F.col("own_license").isNull() & F.col("_dir").isNotNull()).select("_dir").distinct()
    steps = wanted.select("_dir", F.explode(_ancestors(F.col("_dir"))).alias("step")).select("_dir", "step.depth", "step.above")
    nearest = steps.join(given, "above").groupBy("_dir").agg(F.max_by("from", "depth").alias("_from"))
    found = placed.join(nearest, "_dir", "left")
    return found.select(
        F.col("path").alias(path), *keep, "own_license", "cosine",
        F.coalesce("own_license", "_from.own_license").alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").when(F.col("_from").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("_from.path")).alias("license_path"),
    )
