"""Licences of files: TF-IDF similarity of headers and licence files to templates, and inheritance along directories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoralytics.plans.staging import staged

COSINE = 0.7
BLOCK = 6  # paragraphs of the longest header block that is compared as one

_GRANT = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
_LATER = "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_TAIL = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
    "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies."
)

# Texts, titles and notices of common licences. Long licences are known by their titles and headers.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        _GRANT + "Affero General Public License " + _LATER.format(3),
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License.",
    ),
    "BSD-2-Clause": (f"{_BSD_HEAD} 1. {_SOURCE} 2. {_BINARY} {_BSD_TAIL}",),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license, three clause.",
        f"{_BSD_HEAD} 1. {_SOURCE} 2. {_BINARY} 3. {_BSD_NAMES} {_BSD_TAIL}",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0. Creative Commons Attribution International License.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        _GRANT + "General Public License " + _LATER.format(2),
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        _GRANT + "General Public License " + _LATER.format(3),
    ),
    "ISC": (_ISC,),
    "LGPL-2.1": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        _GRANT + "Lesser General Public License " + _LATER.format(2.1),
    ),
    "LGPL-3.0": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        _GRANT + "Lesser General Public License " + _LATER.format(3),
    ),
    "MIT": ("Released under the MIT License.", "The MIT License (MIT)", _MIT, f"{_MIT} {_MIT_TAIL}"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License Version 2.0",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
NOTICE = (
    r"(?i)licen[cs]e|copyright|spdx-|public domain|all rights reserved|redistributions? "
    r"|permission (?:is hereby|to use)|free software"
)
HEAD = r"(?i)copyright|redistribution and use|permission (?:is hereby|to use)"
SPDX = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9][A-Za-z0-9.+-]*(?:\)?[ \t]+(?:AND|OR|WITH)[ \t]+\(?[A-Za-z0-9][A-Za-z0-9.+-]*)*)"
LICENCE_FILE = r"(?i)^(?:licen[cs]e|copying|notice|unlicense)(?:[.-].*)?$"
_LEADER = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--)?[ \t]*"


def _words(text: Column) -> Column:
    """Lower-case runs of letters and digits; a version such as 2.0 stays one word."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.\p{N}+)*"), F.lit(0))


def statements(text: Column, whole: Column) -> Column:
    """The parts of a text to compare with templates: distinct sequences of words, joined by spaces.

    Marks of comments at the start of lines are taken off. Parts that read like a notice are:
    lines, paragraphs (lines up to an empty one, so that wrapped headers come together), their
    sentences, blocks of 2 to ``BLOCK`` paragraphs from one with a copyright line or a grant, or from the one after it,
    and where ``whole`` is true the text itself.
    """
    bare = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), _LEADER, "")
    notices = lambda parts: F.filter(parts, lambda part: part.rlike(NOTICE))
    paragraphs = F.transform(
        F.filter(F.split(bare, r"\n\s*\n"), lambda p: p.rlike(r"\S")), lambda p: F.regexp_replace(p, r"\s+", " ")
    )
    sentences = F.flatten(
        F.transform(notices(paragraphs), lambda p: F.split(p, r"(?<=[.!?])\s+(?=[\p{Lu}(\u0022'])"))
    )

    def blocks(listed: Column) -> Column:
        heads = F.filter(F.transform(listed, lambda p, k: F.when(p.rlike(HEAD), k)), lambda k: k.isNotNull())
        starts = F.array_distinct(F.flatten(F.transform(heads, lambda k: F.array(k, k + 1))))
        return F.flatten(
            F.transform(
                starts,
                lambda k: F.transform(F.sequence(F.lit(2), F.lit(BLOCK)), lambda n: F.array_join(F.slice(listed, k + 1, n), " ")),
            )
        )

    parts = F.concat(
        notices(F.split(bare, "\n")),
        notices(paragraphs),
        notices(sentences),
        notices(blocks(paragraphs)),
        F.when(whole, F.array(bare)).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.transform(parts, lambda part: F.array_join(_words(part), " ")))


def template_cosines(parts: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES) -> DataFrame:
    """``key, licence, cosine``: for ``parts(key, statement)``, one row a binary key, the nearest template.

    Statements are words joined by spaces. Weights are term frequency times
    ``ln((1 + n) / (1 + df)) + 1`` over all statements and templates. Only words that a statement
    shares with a template produce a row of the join; statements that share none are absent.
    Ties go to the first licence by name. Statements travel as words and a digest, never whole.
    """
    spark = parts.sparkSession
    known = spark.createDataFrame(
        [(name, f"{name}/{k}", text) for name, texts in sorted(templates.items()) for k, text in enumerate(texts)],
        "licence string, key string, statement string",
    ).select("licence", F.col("key").cast("binary").alias("key"), _words(F.col("statement")).alias("words"))
    own = parts.select(F.lit(None).cast("string").alias("licence"), "key", F.split("statement", " ").alias("words"))

    def counted(texts: DataFrame) -> DataFrame:
        words = texts.select("licence", "key", F.explode("words").alias("word"))
        return words.groupBy("key", "word", "licence").agg(F.count(F.lit(1)).cast("int").alias("tf"))

    # counted apart, so that statements that lie apart by key already are not shuffled again
    terms = staged(counted(own).union(counted(known)), "licence-terms")
    total = terms.select("key").distinct().count()
    spread = terms.groupBy("word").agg(
        (F.log((1 + F.lit(total)) / (1 + F.count(F.lit(1)))) + 1).alias("idf")
    )
    weighted = staged(
        terms.join(spread, "word").select("licence", "key", "word", (F.col("tf") * F.col("idf")).alias("w")),
        "licence-weights",
    )
    own, model = weighted.where("licence IS NULL"), weighted.where("licence IS NOT NULL")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")))
    lengths = own.groupBy("key").agg(norm.alias("length"))
    model_lengths = model.groupBy(F.col("key").alias("template")).agg(norm.alias("model_length"))
    model = model.select("licence", F.col("key").alias("template"), "word", F.col("w").alias("model_w"))
    dots = (
        own.select("key", "word", "w").join(model, "word")
        .groupBy("key", "licence", "template").agg(F.sum(F.col("w") * F.col("model_w")).alias("dot"))
    )
    cosines = dots.join(lengths, "key").join(model_lengths, "template").select(
        "key", "licence", F.round(F.col("dot") / (F.col("length") * F.col("model_length")), 9).alias("cosine")
    )
    best = F.min(F.struct((-F.col("cosine")).alias("minus"), "licence"))
    return cosines.groupBy("key").agg(best.alias("best")).select(
        "key", "best.licence", (-F.col("best.minus")).alias("cosine")
    )


def scan_licences(
    files: DataFrame,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    cosine: float = COSINE,
    id_col: str = "doc_id",
    path_col: str = "path",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, path, licence, cosine, origin, origin_directory`` for every row of ``files``.

    The first ``SPDX-License-Identifier`` of a text names its licence as written (``spdx``, cosine
    1). Else its notices, header blocks and, in a licence file (by name), the whole text are compared
    with the templates; the nearest at ``cosine`` or more is the file's own licence (``origin`` is
    ``notice``, the highest cosine, then the first name). A licence file gives its licence to
    its directory; a file without its own inherits from its nearest ancestor directory that has
    one (``inherited``). Several licence files of a directory: the highest cosine, then the first
    name. All others have a null licence and ``none``.

    Null or empty texts hold no notice; a null path has no directory. Repeated rows each
    return, an empty table gives no rows, other columns are ignored. Whole texts are never
    shuffled but for those of licence files: only notices, once each, and directories, once
    each, are compared.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    text = F.col(text_col).cast("string")
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    rows = staged(
        files.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            F.col(path_col).cast("string").alias("path"),
            F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("directory"),
            name.alias("name"),
            F.nullif(F.regexp_extract(text, SPDX, 1), F.lit("")).alias("spdx"),
            F.when(text.rlike(NOTICE), statements(text, name.rlike(LICENCE_FILE))).alias("parts"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "licence-files",
    )
    found = rows.where("spdx IS NULL").select("row", F.explode("parts").alias("statement")).where("statement <> ''")
    found = found.withColumn("key", F.unhex(F.md5("statement")))
    nearest = template_cosines(found.select("key", "statement").dropDuplicates(["key"]), templates)
    first = F.min(F.struct((-F.col("cosine")).alias("minus"), "licence"))
    named = nearest.where(F.col("cosine") >= cosine)
    own = staged(found.select("row", "key").join(named, "key").groupBy("row").agg(first.alias("best")), "licence-own")
    direct = F.when(F.col("spdx").isNotNull(), F.struct(F.lit(-1.0).alias("minus"), F.col("spdx").alias("licence")))
    judged = rows.drop("parts").join(own, "row", "left").withColumn("best", F.coalesce(direct, "best"))
    given = (
        judged.where(F.col("best").isNotNull() & F.col("name").rlike(LICENCE_FILE))
        .groupBy("directory").agg(F.min("best").alias("given"))
    )
    # Each directory once, with all its ancestors; the root is the empty path.
    parts = F.split("directory", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    lineage = rows.select("directory").distinct().select(
        "directory", F.explode(F.array_distinct(ancestors)).alias("ancestor")
    )
    held = given.select(F.col("directory").alias("ancestor"), "given")
    nearest_given = lineage.join(held, "ancestor").groupBy("directory").agg(
        F.max_by(F.struct("ancestor", "given"), F.length("ancestor")).alias("inherited")
    )
    joined = judged.join(nearest_given, "directory", "left")
    has_own, heir = F.col("best").isNotNull(), F.col("inherited").isNotNull()
    chosen = F.coalesce("best", "inherited.given")
    return joined.select(
        "doc_id",
        "path",
        chosen["licence"].alias("licence"),
        (-chosen["minus"]).alias("cosine"),
        F.when(F.col("spdx").isNotNull(), "spdx").when(has_own, "notice").when(heir, "inherited").otherwise("none").alias("origin"),
        F.when(~has_own, F.col("inherited.ancestor")).alias("origin_directory"),
    )
