"""Licence scans by sentence rules.

A text is normalised (case, white space, punctuation, comment marks), with a mark wherever a line or a clause ends, and
searched for the known licence sentences, which have identifiers.  A sentence stands between two marks and may have others
inside, so wrapped texts and sentences with ';', ':' or 'v.' are found whole.  The identifiers of a document, in text order, are matched against ordered licence rules: the first rule whose identifiers stand there in
one run wins its run, and the rest is matched on.

The sentences are a constant of this module, so that a row is answered by itself.  Null and empty texts have no sentences and so no licence.  Rows equal in id and text are
answered alike.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Sentences of public licences (normalised as by `normal`) and their identifiers.
SENTENCES = [
    ("licensed under the apache license version 2.0", "apache2"),
    ("licensed under the apache license version 2.0 the license", "apache2-head"),
    ("you may not use this file except in compliance with the license", "apache-use"),
    ("you may obtain a copy of the license at http www.apache.org licenses license-2.0", "apache-copy"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-asis"),
    ("see the license for the specific language governing permissions and limitations under the license", "apache-see"),
    ("released under the mit license", "mit-ref"),
    ("licensed under the mit license", "mit-ref"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "mit-grant"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit-notice"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit-asis"),
    ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit-liability"),
    ("this work is licensed under the gnu general public license version 3", "gpl3-ref"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl3-later"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gpl2-later"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gpl-hope"),
    ("see the gnu general public license for more details", "gpl-see"),
    ("licensed under cc by 4.0", "ccby4"),
    ("licensed under cc by-sa 4.0", "ccbysa4"),
    ("licensed under cc by-nc 4.0", "ccbync4"),
    ("licensed under cc by-nd 4.0", "ccbynd4"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-grant"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd-source"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd-binary"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-name"),
    ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "bsd-asis"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc-grant"),
    ("this source code form is subject to the terms of the mozilla public license v 2.0", "mpl2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "reserved"),
]

# Licences in the order they are tried, as runs of sentence identifiers.
RULES = [
    ("Apache-2.0", ["apache2-head", "apache-use", "apache-copy", "apache-asis", "apache-see"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis", "mit-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-asis"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-asis"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-hope", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-hope", "gpl-see"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("ISC", ["isc-grant"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MPL-2.0", ["mpl2"]),
    ("Unlicense", ["unlicense"]),
    ("Apache-2.0", ["apache2-head", "apache-use"]),
    ("Apache-2.0", ["apache2"]),
    ("GPL-3.0-only", ["gpl3-ref"]),
    ("MIT", ["mit-ref"]),
    ("CC-BY-NC-4.0", ["ccbync4"]),
    ("CC-BY-SA-4.0", ["ccbysa4"]),
    ("CC-BY-ND-4.0", ["ccbynd4"]),
    ("CC-BY-4.0", ["ccby4"]),
]

# A sentence may start and end where a line, or a clause with its sign, ends; it may also go on there, as wrapped lines do.
SENTENCE_END = r"(?<=[.!?;:])[\s]+|\n+"


def normal(text: Column) -> Column:
    """Lower case, punctuation but inner '.', '-' to spaces (and so comment marks, too), one space between words; a newline
    at each place where a sentence may start or end, and around the whole."""
    s = F.regexp_replace(F.lower(text), SENTENCE_END, "\n")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}.\-\n]+", " ")
    s = F.regexp_replace(s, r"(?<![\p{L}\p{N}])[.\-]+|[.\-]+(?![\p{L}\p{N}])", " ")
    s = F.concat(F.lit("\n"), s, F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(s, r" *\n[ \n]*", "\n"), r" +", " ")


def known_sentences(text: Column) -> Column:
    """Identifiers of the known licence sentences of a text, in text order, the longest one at each place."""
    ordered = sorted((s for s, _ in SENTENCES), key=len, reverse=True)
    # lines of these sentences hold letters, digits, '.' and '-' only
    known = "|".join(s.replace(".", r"\.").replace(" ", r"[ \n]") for s in ordered)
    found = F.regexp_extract_all(normal(text), F.lit(rf"(?<=\n)({known})(?=\n)"), 1)
    ids = F.create_map(*[F.lit(x) for pair in SENTENCES for x in pair])
    return F.transform(found, lambda x: ids[F.translate(x, "\n", " ")])


def apply_rules(ids: Column, rules=RULES) -> Column:
    """Licence names of a sequence of identifiers, by the ordered rules; each rule takes all its runs."""
    seq = F.concat(F.lit("|"), F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "|"), F.lit("|"))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("|".join(f"<{i}>" for i in run)).alias("run")) for name, run in rules])
    start = F.struct(seq.alias("left"), F.array().cast("array<string>").alias("found"))
    def step(a, r):
        hit = F.contains(a["left"], F.concat(F.lit("|"), r["run"], F.lit("|")))
        return F.struct(F.when(hit, F.replace(a["left"], r["run"], F.lit("#"))).otherwise(a["left"]).alias("left"),
                        F.when(hit, F.array_union(a["found"], F.array(r["name"]))).otherwise(a["found"]).alias("found"))
    return F.aggregate(table, start, step, lambda a: F.sort_array(a["found"]))


def licence_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): sentence identifiers in order, licences (sorted names,
    empty if none) and status: none, known, or unmatched where known sentences fit no rule."""
    none = F.array().cast("array<string>")
    out = docs.select("doc_id", F.coalesce(known_sentences(F.col("text")), none).alias("sentence_ids"))
    out = out.withColumn("licences", apply_rules(F.col("sentence_ids")))
    return out.withColumn("status", F.when(F.size("sentence_ids") == 0, "none").when(F.size("licences") > 0, "known").otherwise("unmatched"))
