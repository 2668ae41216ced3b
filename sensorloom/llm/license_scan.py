"""License scan by a positional index of rare words (DataFrame functions only).

Templates are licence notices and texts. Their words, with function words left out, are posted with their
positions; of a mandatory phrase every word is. Of the documents' words only those in the vocabulary of the
templates are kept, with positions: one pass over the texts, after which they are not needed any more.
Document frequencies over all documents (a bounded table: one row a word) give each template's rare token: its
mandatory word with the highest IDF. A template is a candidate in every document in which its rare token
stands, however many others are; the postings of all its words are then intersected by relative position, that
is, counted by document, template and offset. A template is found if its mandatory phrase stands there whole
and enough of its words do. As the rare token is part of that phrase, the choice of token costs or saves work
but changes no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_null_safe, materialize, row_hash
from .line_dedup import LOWER, UPPER

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed values. Phrases that are reported wherever they stand: label, words.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Fixed values. Templates: label, text, mandatory phrase.
TEMPLATES = (
    ("agpl", "this program is licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
     you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing
     software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
     see the license for the specific language governing permissions and limitations under the license""", "apache license version 2 0 the license"),
    ("boost", """boost software license version 1 0 august 17th 2003 permission is hereby granted free of charge to any person or organization obtaining
     a copy of the software and accompanying documentation covered by this license""", "boost software license version 1 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
     redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in
     binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
     materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied
     warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed""", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3.0", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by
     the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that
     it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the
     gnu general public license for more details you should have received a copy of the gnu general public license along with this program""",
     "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
     copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with
     regard to this software including all implied warranties of merchantability and fitness""", "with or without fee is hereby granted"),
    ("lgpl", "this library is licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
     to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or
     sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above
     copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as
     is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular
     purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an
     action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
     "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
     distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""",
     "free and unencumbered software released into the public domain"),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
     arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and
     to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must
     not claim that you wrote the original software altered source versions must be plainly marked as such and must not be misrepresented as being
     the original software this notice may not be removed or altered from any source distribution""", "altered source versions must be plainly marked as such"),
)
#: Fixed values. Function words, which are posted within mandatory phrases alone.
COMMON = frozenset("a and any as at be by for from in into is it may must not of on or so such that the this to use will with without you".split())
#: Words that make a document worth a closer look: each template and phrase has one in its mandatory words.
STRONG = ("affero", "apache", "boost", "cc", "gnu", "hereby", "mit", "mozilla", "plainly", "redistribution", "unencumbered")


def postings() -> list[tuple[int, str, int, bool]]:
    """template, word, position, mandatory: base phrases come first, with every word of theirs."""
    out = [(k, w, p, True) for k, (_, phrase) in enumerate(BASE) for p, w in enumerate(phrase.split())]
    for k, (_, text, phrase) in enumerate(TEMPLATES, len(BASE)):
        words, part = text.split(), phrase.split()
        at = next(p for p in range(len(words)) if words[p : p + len(part)] == part)
        must = range(at, at + len(part))
        out += [(k, w, p, p in must) for p, w in enumerate(words) if p in must or w not in COMMON]
    return out


def rules() -> list[tuple[int, str, bool, int, int]]:
    """template, label, base, number of mandatory positions, number of posted ones."""
    posted = postings()
    labels = [(label, True) for label, _ in BASE] + [(label, False) for label, _, _ in TEMPLATES]
    return [(k, label, base, sum(t == k and m for t, _, _, m in posted), sum(t == k for t, _, _, _ in posted)) for k, (label, base) in enumerate(labels)]


def mandatory() -> list[tuple[int, str]]:
    """template, word of the mandatory positions."""
    return sorted({(k, w) for k, w, _, must in postings() if must})


def licence_words(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_words, seen (distinct mandatory words), hits (array of position and word): one pass over the texts."""
    vocabulary = sorted({w for _, w, _, _ in postings()})
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash("text").alias("row"), F.split(text, BREAK).alias("w"))
    lead = F.when(F.col("w")[0] == "", 1).otherwise(0)
    tail = F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0)
    parts = parts.select("doc_id", "row", "w", lead.alias("lead"), (F.size("w") - lead - tail).cast("long").alias("n_words"))
    known = ", ".join(f"'{w}'" for w in vocabulary)
    found = F.expr(f"filter(transform(w, (x, i) -> named_struct('pos', i - lead, 'word', x)), h -> h.word IN ({known}))")
    none = F.expr("cast(array() as array<struct<pos: int, word: string>>)")
    close = F.arrays_overlap("w", F.array(*map(F.lit, STRONG)))
    seen = F.array_intersect("w", F.array(*map(F.lit, sorted({w for _, w in mandatory()}))))
    return parts.select("doc_id", "row", "n_words", seen.alias("seen"), F.when(close, found).otherwise(none).alias("hits"))


def rare_tokens(words: DataFrame) -> DataFrame:
    """template, rare: of each template's mandatory words the one that the fewest documents hold, one row a template."""
    df = words.select(F.explode("seen").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    posted = words.sparkSession.createDataFrame(mandatory(), "template int, word string").join(df, "word", "left")
    return posted.groupBy("template").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("rare"))


def scan(docs: DataFrame, enough: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs(doc_id, text).

    n_base counts all places of the base phrases; first_word and last_word are the smallest and the largest
    word at which one starts (null: none); base_labels and labels are distinct, sorted and joined by commas
    (empty: none). labels also has the templates' labels. score is the best covered share of a found template
    or phrase, 0 without any. A null or empty text has no words. Rows without doc_id and repeated rows are
    reported like others; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    words = materialize(licence_words(docs), "licence-words")
    close = words.where(F.size("hits") > 0)
    posted = spark.createDataFrame(postings(), "template int, word string, at int, must boolean")
    rule = spark.createDataFrame(rules(), "template int, label string, base boolean, need long, posts long")
    # The three tables are bounded by the templates.
    rare = F.broadcast(rare_tokens(words))
    tried = close.dropDuplicates(["doc_id", "row"]).join(rare, F.expr("array_contains(hits.word, rare)"))
    hits = tried.select("doc_id", "row", "template", F.explode("hits").alias("h")).select("doc_id", "row", "template", "h.pos", "h.word")
    votes = hits.join(F.broadcast(posted), ["template", "word"]).withColumn("start", F.col("pos") - F.col("at"))
    # A position of a text meets a position of a template at one start alone, so the rows are the positions that agree.
    places = votes.groupBy("doc_id", "row", "template", "start").agg(F.count(F.lit(1)).alias("held"), F.count_if("must").alias("held_must"))
    places = places.join(F.broadcast(rule), "template").where(F.col("held_must") == F.col("need"))
    share = F.col("held") / F.col("posts")
    places = places.where(F.col("base") | (share >= enough))
    base = F.when(F.col("base"), F.col("start"))
    found = places.groupBy("doc_id", "row").agg(
        F.count(base).alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max(share).alias("score"),
    )
    return join_null_safe(words, found, ["doc_id", "row"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
