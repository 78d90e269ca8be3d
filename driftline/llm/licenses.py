"""Licence scans of files.

A file's notices and, for licence files, its whole text are compared with
licence templates by sparse TF-IDF cosine.  Files without a licence of their
own inherit the one of the nearest directory above them that declares one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.storage import staged
from driftline.llm.textbatch import lowered, runs, split_words, utf8, xxh64

#: Least cosine of a match.
THRESHOLD = 0.8
#: Names of licence files, as a pattern on the last part of the path.
LICENSE_NAME = r"(?i)^(un)?(licen[cs]e|copying|notice)([-._][\w.-]*)?$"

# Wordings of common licence notices and of the openings of licence texts.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "SPDX-License-Identifier: GPL-2.0",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "Released under the BSD License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "Licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "Proprietary": [
        "All rights reserved",
        "Copyright, all rights reserved",
        "All rights reserved, no part may be reproduced without permission",
    ],
}
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def _hashed(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, word bounds of the rows) of runs of texts."""
    buf, offsets = utf8(texts)
    for lo, hi in runs(offsets):
        words = split_words(lowered(buf[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo], _WORD)
        yield lo, xxh64(words.buf, words.starts, words.ends - words.starts), words.first


class Templates:
    """The templates as token vectors over their joint vocabulary."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        flat = [(name, text) for name, texts in templates.items() for text in texts]
        tokens = [next(_hashed(pa.array([text])))[1] for _, text in flat]
        self.names = [name for name, _ in flat]
        self.terms = np.unique(np.concatenate(tokens))
        self.tokens = [np.searchsorted(self.terms, t) for t in tokens]

    def indexed(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers of word hashes, -1 for other words."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)


def document_frequencies(files: DataFrame, known: Templates) -> tuple[int, np.ndarray]:
    """Number of files and, for each template term, of those with it, over all files."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = 0, np.zeros(len(known.terms), dtype=np.int64)
        for batch in batches:
            total += batch.num_rows
            for _, hashes, first in _hashed(batch.column("text")):
                term = known.indexed(hashes)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                pairs = np.unique(row[term >= 0] * len(known.terms) + term[term >= 0])
                counts += np.bincount(pairs % len(known.terms), minlength=len(known.terms))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(found, -1)), pa.array(np.append(counts[found], total))], ["term", "n"]
        )

    rows = files.select("text").mapInArrow(each, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts, total = np.zeros(len(known.terms), dtype=np.int64), 0
    for r in rows:  # a row a term of the templates
        if r.term < 0:
            total = r.n
        else:
            counts[r.term] = r.n
    return total, counts


class Scanner:
    """Cosines of texts to templates under given document frequencies.

    A text with a cosine of ``threshold`` shares terms that hold at least
    ``threshold ** 2`` of the template's squared norm.  So it has one of the
    template's rarest terms that together hold more than the rest may: its
    anchors.  Only texts and stretches with an anchor are measured.
    """

    def __init__(self, known: Templates, total: int, counts: np.ndarray, threshold: float = THRESHOLD) -> None:
        self.known = known
        self.idf2 = (np.log((1 + total) / (1 + counts)) + 1) ** 2
        self.other = (np.log(1 + total) + 1) ** 2  # of words that no template has
        size = len(known.terms)
        self.vectors = [np.bincount(t, minlength=size) for t in known.tokens]
        self.norms = [float(np.sqrt((v * v * self.idf2).sum())) for v in self.vectors]
        self.anchors = np.zeros((len(self.norms), size), dtype=bool)
        for k, (vector, norm) in enumerate(zip(self.vectors, self.norms, strict=True)):
            own = np.flatnonzero(vector)
            mass = vector[own] ** 2 * self.idf2[own]
            rarest = np.lexsort((-mass, counts[own]))
            rest = norm**2 - np.cumsum(mass[rarest])
            needed = int(np.argmax(rest < threshold**2 * norm**2 * (1 - 1e-9))) + 1
            self.anchors[k, own[rarest[:needed]]] = True
        self.anchor_hashes = np.sort(known.terms[self.anchors.any(axis=0)])

    def whole(self, hashes: np.ndarray) -> np.ndarray:
        """Cosine of a whole text to every template."""
        term = self.known.indexed(hashes)
        mine = np.bincount(term[term >= 0], minlength=len(self.known.terms))
        rest = np.unique(hashes[term < 0], return_counts=True)[1]
        norm = np.sqrt((mine * mine * self.idf2).sum() + (rest * rest).sum() * self.other)
        if not norm:
            return np.zeros(len(self.norms))
        return np.array([(mine * v * self.idf2).sum() / (norm * n) for v, n in zip(self.vectors, self.norms, strict=True)])

    def notices(self, hashes: np.ndarray) -> np.ndarray:
        """Highest cosine to every template of any stretch of its length that holds one of its anchors; 0 without one."""
        best = np.zeros(len(self.norms))
        term = self.known.indexed(hashes)
        inside = np.flatnonzero(term >= 0)
        weight = np.where(term >= 0, self.idf2[term], self.other)
        for k, (tokens, vector, norm) in enumerate(zip(self.known.tokens, self.vectors, self.norms, strict=True)):
            at = inside[self.anchors[k][term[inside]]]
            if not len(at):
                continue
            size = min(len(tokens), len(hashes))
            gain = np.concatenate([[0.0], np.cumsum(np.where(term >= 0, vector[term], 0) * weight)])
            starts = np.unique(np.clip(at[:, None] - np.arange(size), 0, len(hashes) - size).ravel())
            # Only stretches that could still win are measured: a norm is at least that of distinct words.
            dots = gain[starts + size] - gain[starts]
            for i in np.argsort(-dots, kind="stable").tolist():
                if dots[i] <= best[k] * norm * np.sqrt(size):
                    break  # every weight is 1 at least, so no later stretch is nearer
                length = np.sqrt(self._square(hashes, weight, int(starts[i]), size))
                best[k] = max(best[k], dots[i] / (length * norm))
        return best

    @staticmethod
    def _square(hashes: np.ndarray, weight: np.ndarray, start: int, size: int) -> float:
        part = hashes[start : start + size]
        _, first, n = np.unique(part, return_index=True, return_counts=True)
        return float((weight[start : start + size][first] * n * n).sum())


def own_licenses(files: DataFrame, threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``row`` (all columns but path and text), ``path``, ``own`` (licence or null), ``score`` and ``is_file`` (a licence file).

    The whole text is scanned: its best-matching notice, or for a file with a
    licence's name or text the file itself.  Of equal cosines the first template
    counts.  Null and empty texts have no licence; repeated rows get one each.
    """
    known = Templates(templates or TEMPLATES)
    total, counts = document_frequencies(files, known)
    others = [F.col(f"`{c}`") for c in files.columns if c not in ("path", "text")]
    packed = files.select(F.struct(*(others or [F.lit(0).alias("none")])).alias("row"), "path", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, total, counts, threshold)
        for batch in batches:
            own: list[str | None] = [None] * batch.num_rows
            score, whole = np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=bool)
            for lo, hashes, first in _hashed(batch.column("text")):
                held = np.flatnonzero(np.isin(hashes, scanner.anchor_hashes))
                for row in np.unique(np.searchsorted(first, held, side="right") - 1).tolist():
                    part = hashes[first[row] : first[row + 1]]
                    notice, entire = scanner.notices(part), scanner.whole(part)
                    both = np.round(np.maximum(notice, entire), 9)
                    k = int(both.argmax())
                    score[lo + row] = both[k]
                    if both[k] >= threshold:
                        own[lo + row] = known.names[k]
                        whole[lo + row] = entire[k] >= threshold
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("path"), pa.array(own, pa.string()), pa.array(score), pa.array(whole)],
                ["row", "path", "own", "score", "whole"],
            )

    added = [T.StructField("own", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("whole", T.BooleanType())]
    found = packed.mapInArrow(each, T.StructType([packed.schema["row"], packed.schema["path"], *added]))
    name = F.coalesce(F.element_at(F.split("path", "/"), -1), F.lit(""))
    return found.withColumn("is_file", F.col("own").isNotNull() & (F.col("whole") | name.rlike(LICENSE_NAME))).drop("whole")


def parent(path: Column) -> Column:
    """The directory of a path; empty at the top, null for a null path."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def declared(own: DataFrame) -> DataFrame:
    """``dir, license`` of directories: of their licence files, else what most of their files' notices say.

    Ties go to the first name; files without path or licence have no vote, repeated rows one each.
    """
    votes = own.filter("own IS NOT NULL AND path IS NOT NULL").groupBy(parent(F.col("path")).alias("dir"), "is_file", "own").count()
    return votes.groupBy("dir").agg(
        F.min(F.struct(~F.col("is_file"), -F.col("count"), F.col("own").alias("license"))).alias("first")
    ).select("dir", "first.license")


def nearest_declared(dirs: DataFrame, declarations: DataFrame) -> DataFrame:
    """``dir, declared_in, license``: for each directory the nearest of itself and its ancestors that declares one."""
    parts = F.split("dir", "/")
    above = dirs.select(
        "dir",
        F.explode(
            F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(
                F.concat(
                    F.array(F.lit("")),
                    F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")),
                )
            )
        ).alias("declared_in"),
    )
    met = above.join(declarations.withColumnRenamed("dir", "declared_in"), "declared_in")
    deepest = F.max_by(F.struct("declared_in", "license"), F.char_length("declared_in")).alias("near")
    return met.groupBy("dir").agg(deepest).select("dir", "near.declared_in", "near.license")


def scan(files: DataFrame, threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """The licence of every file.

    ``files`` has columns path and text.  Returns its other columns and path with
    ``license, score, found`` (file, notice, inherited or none) and ``declared_in``
    (the directory inherited from); columns of ``files`` with these four names
    give way to them.  Null texts have no licence of their own; null paths
    neither declare nor inherit; repeated rows are returned each; no files give none.
    """
    own = staged(own_licenses(files, threshold, templates), "licenses")
    declarations = staged(declared(own), "license-dirs")
    dirs = own.filter("path IS NOT NULL").select(parent(F.col("path")).alias("dir")).distinct()
    near = nearest_declared(dirs, declarations)
    mine = F.col("own").isNotNull()
    results = {
        "license": F.coalesce("own", "license"),
        "score": F.col("score"),
        "found": F.when(F.col("is_file"), "file").when(mine, "notice").when(F.col("license").isNotNull(), "inherited").otherwise("none"),
        "declared_in": F.when(~mine, F.col("declared_in")),
    }
    kept = [c for c in files.columns if c != "text" and c not in results]
    return (
        own.withColumn("dir", parent(F.col("path")))
        .join(near, "dir", "left")
        .select(
            *[(F.col("path") if c == "path" else F.col(f"row.`{c}`")).alias(c) for c in kept],
            *[value.alias(name) for name, value in results.items()],
        )
    )


def page_files(pages: DataFrame) -> DataFrame:
    """Web pages as files: the URL without scheme, query and fragment, and the HTML without tags."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    text = F.regexp_replace("html", r"<[^>]*>", " ")
    return pages.select("page_id", path.alias("path"), text.alias("text"))
