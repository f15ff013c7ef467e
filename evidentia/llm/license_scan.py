"""Licence texts and phrases by diagonal voting, in DataFrame functions only.

Every rolling k-word window of a text is hashed; windows whose hash is that of no template window are dropped
inside the array, which changes no match. The others join the template positions (fixed values below, so of
fixed size) on the hash, and their words confirm. A match of window i with template position j votes for the diagonal
i - j: it sets bit j of the diagonal. Diagonals within ``GAP`` of each other merge, and so do their bits, so that
a position met twice counts once. A merged span is verified by its share of the template's windows and its length;
of notices that overlap in a text the best covered one counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, GAP, COVERAGE, STRETCH = 3, 3, 0.6, 1.5
#: Template windows whose votes are the bits of one long.
_BITS = 60

#: Phrases that count as such wherever their words stand consecutively.
PHRASES = [
    ("the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Notices of well-known licences, as words of their published texts.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
        "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language "
        "governing permissions and limitations under the license",
        "apache-2",
    ),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later "
        "version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more "
        "details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses",
        "gpl-3",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later "
        "version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more "
        "details you should have received a copy of the gnu general public license along with this program if not write to the free software foundation inc",
        "gpl-2",
    ),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any "
        "later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public "
        "license for more details",
        "lgpl-2.1",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any "
        "later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public "
        "license for more details",
        "agpl-3",
    ),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
        "distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
        "purpose are disclaimed",
        "bsd-2",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
        "distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by "
        "the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "bsd-3",
    ),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided "
        "as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential "
        "damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unlicense"),
]


def _windows(words: str) -> list[str]:
    w = words.split()
    return [" ".join(w[i : i + K]) for i in range(len(w) - K + 1)]


def _templates(spark) -> DataFrame:
    """(h, gram, template, label, base, j, grams, n): every window of every template."""
    rows = [F.struct(F.lit(t).alias("template"), F.split(F.lit(words), " ").alias("w"), F.lit(label).alias("label"), F.lit(t < len(PHRASES)).alias("base")) for t, (words, label) in enumerate(PHRASES + NOTICES)]
    t = spark.range(1).select(F.inline(F.array(*rows)))
    t = t.withColumn("grams", F.size("w") - (K - 1)).select("*", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)).alias("j"))
    at = [F.get("w", F.col("j") + k) for k in range(K)]
    return t.select(F.xxhash64(*at).alias("h"), F.concat_ws(" ", *at).alias("gram"), "template", "label", "base", "j", "grams", F.size("w").alias("n"))


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    n_spans), one row per input row. Null is the empty text (no words, empty labels, score 0). Words are runs of ASCII
    digits, letters (A-Z lower-cased) and all non-ASCII characters. score is the best covered share of a template; 1
    where a phrase stands. n_spans counts the places of phrases and the notices that count."""
    spark = docs.sparkSession
    templates = _templates(spark)
    grams = sorted({g for w, _ in PHRASES + NOTICES for g in _windows(w)})
    first = sorted({g.split()[0] for g in grams})
    # the hashes of a few thousand fixed windows, so that the windows of a text are tested where they are made
    wanted = [r.h for r in templates.select("h").distinct().collect()]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # of non-ASCII characters only the Kelvin sign becomes an ASCII letter alone when lower-cased: it is put
    # aside, so that lower() equals a plain A-Z lower-casing wherever a template word could match
    low = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00b5")))
    words = F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), words.alias("w"))
    at = lambda i: [F.get("w", i + k) for k in range(K)]
    window = lambda x, i: F.when(x.isin(first), F.when(F.xxhash64(*at(i)).isin(wanted), F.struct(i.alias("i"), F.xxhash64(*at(i)).alias("h"), F.concat_ws(" ", *at(i)).alias("gram"))))
    # one row of each text says how many words it has
    size = F.array(F.struct((-F.size("w") - 1).alias("i"), F.lit(0).cast("long").alias("h"), F.lit("").alias("gram")))
    found = F.filter(F.transform("w", window), lambda g: g.isNotNull())
    rows = d.select("doc_id", "key", F.explode(F.concat(size, found)).alias("g")).select("doc_id", "key", "g.*")
    voted = rows.join(F.broadcast(templates), ["h", "gram"], "left").filter("template is not null or i < 0")
    on, spot = ["doc_id", "key"], ["template", "label", "base", "grams", "n"]
    longs = range((max(len(_windows(w)) for w, _ in PHRASES + NOTICES) + _BITS - 1) // _BITS)
    bit = lambda k: F.bit_or(F.when((F.col("j") >= k * _BITS) & (F.col("j") < (k + 1) * _BITS), F.expr(f"shiftleft(1L, j - {k * _BITS})")))
    place = F.col("i") - F.coalesce("j", F.lit(0))
    diagonals = voted.groupBy(*on, *spot, place.alias("d")).agg(*(bit(k).alias(f"v{k}") for k in longs), F.min("i").alias("lo"), F.max("i").alias("hi"), F.count("*").alias("rows"))
    along = Window.partitionBy(*on, "template").orderBy("d")
    gap = F.col("d") - F.lag("d").over(along)
    # phrases need their very diagonal, so only notices merge
    diagonals = diagonals.withColumn("new", F.when(F.col("template").isNull() | F.col("base") | gap.isNull() | (gap > GAP), 1).otherwise(0))
    diagonals = diagonals.withColumn("span", F.sum("new").over(along))
    spans = diagonals.groupBy(*on, *spot, "span").agg(*(F.bit_or(f"v{k}").alias(f"v{k}") for k in longs), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("d").alias("d"), F.sum("rows").alias("rows"))
    votes = sum((F.coalesce(F.bit_count(f"v{k}"), F.lit(0)) for k in longs), F.lit(0))
    spans = spans.withColumn("votes", votes).withColumn("share", F.col("votes") / F.col("grams"))
    fits = F.when(F.col("base"), F.col("votes") == F.col("grams")).otherwise((F.col("share") >= COVERAGE) & (F.col("hi") - F.col("lo") + K <= F.col("n") * STRETCH))
    spans = spans.withColumn("fits", F.coalesce(fits, F.lit(False)))
    # notices that fit and overlap, directly or by others between: the best covered, then the longest counts
    apart = F.col("lo") > F.max("hi").over(Window.partitionBy(*on, "rival").orderBy("lo", "template", "span").rowsBetween(Window.unboundedPreceding, -1)) + K - 1
    spans = spans.withColumn("rival", F.col("fits") & ~F.col("base")).withColumn("apart", F.when(apart, 1).otherwise(0))
    spans = spans.withColumn("heap", F.sum("apart").over(Window.partitionBy(*on, "rival").orderBy("lo", "template", "span")))
    best = F.row_number().over(Window.partitionBy(*on, "rival", "heap").orderBy(F.desc("share"), F.desc("votes"), "template", "span")) == 1
    spans = spans.withColumn("counts", F.col("fits") & (F.coalesce("base", F.lit(False)) | best))
    base = F.col("counts") & F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = spans.groupBy(*on).agg(
        F.max(F.when(F.col("template").isNull(), -F.col("lo") - 1)).cast("long").alias("n_words"),
        F.max(F.when(F.col("template").isNull(), F.col("rows"))).alias("copies"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("d"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("d"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("counts")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("counts"), F.col("share"))), F.lit(0.0)).alias("score"),
        F.count_if("counts").alias("n_spans"),
    )
    # equal rows went through as one
    return out.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("key", "copies", "k")
