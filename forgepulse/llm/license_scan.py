"""Operator 2: licence scan by diagonal voting.

Every rolling word 3-gram of every document is joined with the positions of the same 3-gram in the templates (a fixed,
small table).  A hit votes for the diagonal document position minus template position; neighbouring diagonals of a
template merge (words put in or left out).  A span is verified by what it holds: enough of the template's places must have
been met, each counted once however often it voted, and enough of the span's words must lie in a 3-gram that voted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .repeats import groups

#: Word bytes, after A-Z became a-z: digits, a-z and all beyond ASCII.
BREAK = np.ones(256, dtype=bool)
BREAK[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = False
BREAK[128:] = False

#: The base phrases with their labels.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Well-known notices of public licences, with the labels that the method gives.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license"),
    ("cc-by", "licensed under a creative commons attribution license"),
)
GRAM = 3
#: Sentinel hash of the row that each document sends for itself.
OWN = 0


def grams(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text's number and word position of each 3-gram, and the words of each text."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b" ".join([t.data for t in texts]).lower(), dtype=np.uint8)
    starts, ends = C.word_bounds(data, BREAK)
    offsets = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes + 1))))
    counts = np.diff(offsets)
    n = len(starts) - GRAM + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, counts
    i = np.arange(n)
    h = C.Rolling(C.word_hashes(data, starts, ends)).of(i, i + GRAM)
    doc = np.repeat(np.arange(len(texts)), counts)
    inside = doc[:n] == doc[GRAM - 1 :]
    i, doc = i[inside], doc[:n][inside]
    return C.signed(h[inside]), doc, i - offsets[doc], counts


def _send(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in groups(frames, 1 << 18):
        h, doc, at, counts = grams(texts)
        n = len(counts)
        rows, ids = batch.column("row").to_numpy(), batch.column("doc_id")
        which = np.concatenate((np.arange(n), doc))
        yield pa.RecordBatch.from_arrays([pa.array(rows[which]), ids.take(pa.array(which)), pa.array(np.concatenate((counts, at)).astype(np.int32)), pa.array(np.concatenate((np.full(n, OWN, dtype=np.int64), h)))], names=["row", "doc_id", "at", "gram"])


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """gram, template (a number, -1 for the document's own row), place, grams (in the template), base, label."""
    rows = [(OWN, -1, 0, 0, False, "")]
    for number, (base, label, text) in enumerate([*((True, *p) for p in phrases), *((False, *p) for p in notices)]):
        h, _, at, _ = grams([np.frombuffer(text.encode(), dtype=np.uint8)])
        rows += [(int(x), number, int(p), len(h), base, label) for x, p in zip(h, at, strict=True)]
    return spark.createDataFrame(rows, "gram long, template int, place int, grams int, base boolean, label string")


def license_scan(df: DataFrame, phrases=PHRASES, notices=NOTICES, coverage: float = 0.7, short: int = 12, gap: int = 2) -> DataFrame:
    """One row per row of df (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Null and empty texts have no words and score 0; equal rows each get a row; an empty table gives an empty one; other columns
    are ignored.  A notice counts from `coverage` of its 3-grams on, one of under `short` only whole; diagonals at most `gap` apart merge,
    and at least half of the span's words must lie in 3-grams that voted.  score is the best coverage, 1 for a base phrase.  spans lists
    label, first word, end.
    """
    C.prepare(df.sparkSession)
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), C.text_col().alias("text"))
    sent = docs.mapInArrow(_send, "row long, doc_id long, at int, gram long")
    hits = sent.join(F.broadcast(templates(df.sparkSession, phrases, notices)), "gram")  # the templates are a fixed, small table
    diagonals = hits.groupBy("row", "doc_id", "template", (F.when(F.col("template") < 0, 0).otherwise(F.col("at") - F.col("place"))).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"), F.first("grams").alias("grams"), F.first("base").alias("base"), F.first("label").alias("label"), F.collect_set("place").alias("places")
    )
    order = Window.partitionBy("row", "doc_id", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > gap).cast("int")
    groups_ = diagonals.withColumn("apart", F.coalesce(apart, F.lit(0))).withColumn("run", F.sum("apart").over(order))
    full = F.col("base") & (F.col("votes") == F.col("grams"))
    spans = groups_.groupBy("row", "doc_id", "template", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("met"), F.min("first").alias("first"), (F.max("last") + GRAM).alias("end"), F.first("grams").alias("grams"), F.first("base").alias("base"), F.first("label").alias("label"),
        F.count_if(full).alias("n_base"), F.min(F.when(full, F.col("diagonal"))).alias("low"), F.max(F.when(full, F.col("diagonal"))).alias("high"),
    )
    covered = F.col("met") / F.col("grams")  # a diagonal holds a place once, so met is at most grams
    length = F.col("end") - F.col("first")
    good = F.when(F.col("base"), F.col("n_base") > 0).otherwise((covered >= F.when(F.col("grams") < short, 1.0).otherwise(coverage)) & (length <= 2 * (F.col("met") + GRAM - 1)))
    good = (F.col("template") >= 0) & good
    out = spans.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("template") < 0, F.col("first"))).cast("long").alias("n_words"),
        F.coalesce(F.sum("n_base"), F.lit(0)).cast("long").alias("n_base"),
        F.min("low").cast("long").alias("first_word"), F.max("high").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(good & F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(good, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(good, F.when(F.col("base"), 1.0).otherwise(covered))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(good, F.struct("first", "end", "label")))).alias("spans"),
    )
    return out.drop("row")
