"""License scan by diagonal voting.

Every template (phrase or notice) is cut into word k-grams with their positions; so is every document. A join on
the k-gram hash gives (document position, template position) pairs, and pairs of one copy share the difference of
the two, their diagonal. Votes are summed by diagonal, neighbouring diagonals (a word more or less in the copy) are
merged, and a merged span is verified by the share of the template's words that it covers.

The document side is never shuffled: the k-grams of the templates are a table of fixed, counted size that goes to
every task, and only hits travel. Everything is DataFrame functions.

A gram's hash only finds it: hits are taken if the words themselves are equal.

Defined results: null or empty text = no words, no labels, score 0; repeated rows are each returned, rows with equal
doc_id and other texts are judged each by its own (null doc_id is a value like any other); an empty table gives
an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._common import texts
from tessera.llm._windows import windows

K = 3
#: Diagonals this near belong to one copy; a span may be longer than its template by DRIFT words in all. The share is
#: high enough that one word tells licenses apart whose notices differ in it.
DRIFT = 4
COVER = 0.85
#: More template k-grams than this are not sent to every task but joined by a shuffle.
MOST_SENT = 200_000

# Phrases whose every place counts, with their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Notices and paragraphs of license texts that may be quoted with small changes, each a template of its
# own, with their labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit"),
    ("licensed under the mit license", "mit"),
    ("released under the mit license", "mit"),
    ("distributed under the mit license", "mit"),
    ("the mit license mit", "mit"),
    ("spdx license identifier mit", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache-2"),
    ("apache license 2 0", "apache-2"),
    ("apache 2 0 license", "apache-2"),
    ("apache software license 2 0", "apache-2"),
    ("spdx license identifier apache 2 0", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu general public license v3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3"),
    ("gpl v3 licensed", "gpl-3"),
    ("gpl v3 license", "gpl-3"),
    ("under the gpl v3", "gpl-3"),
    ("under the gplv3", "gpl-3"),
    ("spdx license identifier gpl 3 0", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license v2", "gpl-2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gpl-2"),
    ("gpl v2 licensed", "gpl-2"),
    ("gpl v2 license", "gpl-2"),
    ("under the gpl v2", "gpl-2"),
    ("spdx license identifier gpl 2 0", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("spdx license identifier lgpl", "lgpl"),
    ("gnu affero general public license", "agpl-3"),
    ("spdx license identifier agpl 3 0", "agpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd"),
    ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "bsd"),
    ("under the bsd license", "bsd"),
    ("spdx license identifier bsd 3 clause", "bsd"),
    ("spdx license identifier bsd 2 clause", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("spdx license identifier mpl 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("spdx license identifier isc", "isc"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "zlib"),
    ("eclipse public license v 2 0", "epl-2"),
    ("boost software license version 1 0", "bsl-1"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("cc0 1 0 universal", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
]


def lowered(text: Column) -> Column:
    """A-Z in lower case. lower() does that and leaves every ASCII letter right but for two signs it maps into ASCII."""
    exact = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(text.contains("\u0130") | text.contains("\u212a"), exact).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    rows = [(i, text, label, base) for i, (text, label, base) in enumerate([(*p, True) for p in phrases] + [(*n, False) for n in notices])]
    values = ", ".join(f"({i}, '{text}', '{label}', {str(base).lower()})" for i, text, label, base in rows)  # words and labels hold no quotes
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(template, text, label, base)")


_words = [f"w{k}" for k in range(K)]


def gram() -> Column:
    return F.xxhash64(*_words)


def scan_licenses(docs: DataFrame, table: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    table: template int, text, label, base (count every verbatim place) of at least K words each.
    """
    docs = texts(docs, id_col, text_col).withColumn("sha", F.xxhash64("text"))
    table = templates(docs.sparkSession) if table is None else table
    known = table.withColumn("tw", words(F.col("text")))
    grams = windows(known, F.col("tw"), K, ["template"]).where("pos is not null").select("template", F.col("pos").alias("at"), gram().alias("gram"), F.array(*_words).alias("theirs"))
    if grams.count() <= MOST_SENT:
        grams = F.broadcast(grams)

    hits = windows(docs, words(F.col("text")), K, ["doc_id", "sha"]).select("doc_id", "sha", "pos", gram().alias("gram"), *_words)
    hits = hits.join(grams, "gram").where(F.array(*_words) == F.col("theirs"))
    hits = hits.groupBy("doc_id", "sha", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))
    lengths = known.select("template", "label", "base", F.size("tw").alias("n"))
    hits = hits.join(F.broadcast(lengths), "template")

    of = Window.partitionBy("doc_id", "sha", "template").orderBy("diagonal")
    merged = hits.withColumn("new", (F.col("diagonal") - F.lag("diagonal", 1, -(10**9)).over(of) > DRIFT).cast("int")).withColumn("copy", F.sum("new").over(of))
    covered = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("ats")), lambda a: F.sequence(a, a + K - 1))))
    first = F.min(F.col("diagonal") + F.array_min("ats"))
    end = F.max(F.col("diagonal") + F.array_max("ats") + K)
    whole = F.col("base") & (F.size("ats") == F.col("n") - K + 1)
    merged = merged.groupBy("doc_id", "sha", "template", "copy").agg(
        F.first("label").alias("label"), F.first("n").alias("n"), F.size(covered).alias("covered"), first.alias("first"), end.alias("end"),
        F.count_if(whole).alias("places"), F.min(F.when(whole, F.col("diagonal"))).alias("low"), F.max(F.when(whole, F.col("diagonal"))).alias("high"),
    )
    share = F.when(F.col("places") > 0, F.lit(1.0)).otherwise(F.col("covered") / F.col("n"))
    held = (F.col("places") > 0) | ((share >= COVER) & (F.col("end") - F.col("first") <= F.col("n") + DRIFT))
    merged = merged.withColumns({"share": share, "held": held})
    joined = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    per_doc = merged.groupBy("doc_id", "sha").agg(
        F.sum("places").alias("n_base"), F.min("low").alias("first_word"), F.max("high").alias("last_word"), joined(F.col("places") > 0).alias("base_labels"), joined(F.col("held")).alias("labels"),
        F.max("share").alias("score"), F.array_sort(F.collect_list(F.when(F.col("held"), F.struct("first", "end", "label")))).alias("spans"),
    )

    sized = docs.select("doc_id", "sha", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    found = sized.alias("s").join(per_doc.alias("p"), F.col("s.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("s.sha") == F.col("p.sha")), "left")
    none = F.lit("")
    return found.select(
        "s.doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
