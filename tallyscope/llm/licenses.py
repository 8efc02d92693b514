"""Licence scans by recognised sentences and ordered rules over their sequence.

A text is cut into passages (at blank lines, and after ``.``, ``!`` or ``?``
before white space); a line without a letter or digit is blank, and comment
marks are no part of a line. A sentence is a run of whole lines of a passage, so
wrapped text counts like text in one line, and so does a notice in a line of
its own. It is normalised (a-z and 0-9 in lower case, all else one space) and
looked up in a table of known licence sentences, the longest first, which gives
its identifier. The identifiers of a document, in the order of the text,
are then read by rules in their order: a rule names a licence and a sequence of
identifiers that follow one another; what a rule has matched is taken out
before the next rule is tried, so notices of several sentences win over the
single sentences in them.

All of it is DataFrame expressions: no join (both tables are short literals),
no shuffle, no Python in tasks. Texts without any word that the known sentences
need are passed over before they are cut.

Defined cases: a null or empty text has no sentence and no licence; repeated
sentences match as often as they occur; extra columns are passed over; an empty
table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import table

#: Known licence sentences, normalised, and their identifiers. Public licence texts.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "apache-grant",
    "you may not use this file except in compliance with the license": "apache-terms",
    "you may obtain a copy of the license at": "apache-copy",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied": "mit-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "this work is licensed under the gnu general public license version 2": "gpl-2-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "licensed under cc by sa 4 0": "cc-by-sa-4",
    "licensed under cc by 4 0": "cc-by-4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorsement",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed": "bsd-warranty",
    "licensed under the mozilla public license version 2 0": "mpl-2-notice",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
    "all rights reserved": "all-rights",
    # the sentences as the licences have them
    "licensed under the apache license version 2 0 the license": "apache-grant",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-grant",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-grant",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-url",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-url",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-warranty",
    "apache license version 2 0 january 2004": "apache-text",
    "this project is licensed under the apache license version 2 0": "apache-grant",
    "released under the apache license version 2 0": "apache-grant",
    "licensed under the apache license 2 0": "apache-grant",
    "licensed under the apache 2 0 license": "apache-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement": "bsl-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "this project is released under the mit license": "mit-notice",
    "this software is licensed under the mit license": "mit-notice",
    "this software is released under the mit license": "mit-notice",
    "distributed under the mit license": "mit-notice",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-liability",
    "gnu general public license version 3 29 june 2007": "gpl-3-text",
    "gnu general public license version 2 june 1991": "gpl-2-text",
    "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses": "gpl-copy",
    "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses": "gpl-copy",
    "you should have received a copy of the gnu general public license along with this program if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa": "gpl-copy",
    "you should have received a copy of the gnu general public license along with this program if not write to the free software foundation inc 59 temple place suite 330 boston ma 02111 1307 usa": "gpl-copy",
}

#: Licence and sequence of identifiers, in the order in which rules are tried.
RULES: list[tuple[str, list[str]]] = [
    # a full text holds the header that it recommends
    ("GPL-3.0-only", ["gpl-3-text", "gpl-3-grant", "gpl-warranty", "gpl-copy"]),
    ("GPL-2.0-only", ["gpl-2-text", "gpl-2-grant", "gpl-warranty", "gpl-copy"]),
    ("Apache-2.0", ["apache-text", "apache-grant", "apache-url", "apache-warranty"]),
    ("Apache-2.0", ["apache-text", "apache-grant", "apache-copy", "apache-warranty"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorsement", "bsd-warranty", "bsd-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorsement", "bsd-warranty"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("Apache-2.0", ["apache-grant", "apache-url", "apache-warranty"]),
    ("Apache-2.0", ["apache-grant", "apache-copy", "apache-warranty"]),
    ("Apache-2.0", ["apache-grant", "apache-url"]),
    ("Apache-2.0", ["apache-grant", "apache-copy"]),
    ("GPL-3.0-or-later", ["gpl-3-grant", "gpl-warranty", "gpl-copy"]),
    ("GPL-2.0-or-later", ["gpl-2-grant", "gpl-warranty", "gpl-copy"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("MIT", ["mit-notice", "mit-grant"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-endorsement", "bsd-warranty"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-warranty"]),
    ("Apache-2.0", ["apache-grant", "apache-terms", "apache-copy"]),
    ("Apache-2.0", ["apache-grant", "apache-terms"]),
    ("Apache-2.0", ["apache-grant"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-grant"]),
    ("GPL-3.0-only", ["gpl-3-notice"]),
    ("GPL-2.0-only", ["gpl-2-notice"]),
    ("GPL-3.0-or-later", ["gpl-3-grant"]),
    ("GPL-2.0-or-later", ["gpl-2-grant"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("BSD-2-Clause", ["bsd-grant"]),
    ("MPL-2.0", ["mpl-2-notice"]),
    ("Unlicense", ["unlicense-notice"]),
    # sentences that only one licence has, on their own
    ("GPL-3.0-only", ["gpl-3-text"]),
    ("GPL-2.0-only", ["gpl-2-text"]),
    ("Apache-2.0", ["apache-text"]),
    ("Apache-2.0", ["apache-url"]),
    ("MIT", ["mit-condition", "mit-warranty"]),
    ("MIT", ["mit-condition"]),
    ("MIT", ["mit-warranty"]),
    ("BSL-1.0", ["bsl-warranty"]),
    ("proprietary", ["all-rights"]),
]

#: Every known sentence holds one of these; sentences and texts without any are passed over.
NEEDED = ["licen", "software", "copyright", "rights", "program", "redistribution"]


def _needed(c: Column) -> Column:
    return c.rlike("(?i)" + "|".join(NEEDED))


#: Any known sentence, in whole lines of a passage (``|`` is a line end); the longest is tried first.
KNOWN = r"(?:^|\|)(?:" + "|".join(s.replace(" ", "[ |]") for s in sorted(SENTENCES, key=len, reverse=True)) + r")(?=\||$)"


def lines(passage: Column) -> Column:
    """Letters a-z and digits, line ends as ``|``, all else one space."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(passage), "[^a-z0-9\n]+", " ")), " ?\n ?", "|")


def passages(text: Column) -> Column:
    """The passages of a text that could hold known sentences, normalised."""
    bare = F.regexp_replace(text, r"(?im)^[ \t]*(?:rem|dnl)(?=[ \t\r\n])", "")
    cut = F.split(F.regexp_replace(bare, r"([.!?])\s+", "$1\n\n"), r"\n[^A-Za-z0-9]*\n")
    return F.transform(F.filter(cut, _needed), lines)


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    runs = F.flatten(F.transform(passages(text), lambda p: F.regexp_extract_all(p, F.lit(KNOWN), F.lit(0))))
    found = F.transform(runs, lambda s: F.try_element_at(known, F.trim(F.replace(s, F.lit("|"), F.lit(" ")))))
    return F.when(text.isNotNull() & _needed(text), found).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Known sentences, the rules they match and the licences, of every row."""
    out = docs.select(F.col(id_col), identifiers(F.col(text_col)).alias("ids"))
    # each identifier stands between bars of its own, so sequences match whole identifiers only
    out = out.withColumn("left", F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
    hits = []
    for k, (_, sequence) in enumerate(RULES):
        pattern = "".join(f"<{x}>" for x in sequence)
        rest = F.replace(F.col("left"), F.lit(pattern), F.lit("|"))
        count = ((F.length("left") - F.length(rest)) / (len(pattern) - 1)).cast("long")
        out = out.withColumn(f"hit{k}", F.when(F.col("left").contains(pattern), count).otherwise(F.lit(0).cast("long")))
        out = out.withColumn("left", F.when(F.col("left").contains(pattern), rest).otherwise(F.col("left")))
        hits.append(f"hit{k}")
    named = F.array(*[F.when(F.col(h) > 0, F.lit(name)) for h, (name, _) in zip(hits, RULES, strict=True)])
    licences = F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull())))
    return out.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        sum(F.col(h) for h in hits).alias("n_matches"),
        F.array_join(licences, ",").alias("licenses"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every text of ``documents``."""
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The scan in DuckDB SQL, written as a chain of lists; a sentence here is a line or a part of one."""
    known = ", ".join(f"'{s}': '{i}'" for s, i in SENTENCES.items())
    needed = "|".join(NEEDED)
    steps, hits = [], []
    last = "ids_text"
    for k, (_, sequence) in enumerate(RULES):
        pattern = "".join(f"<{x}>" for x in sequence)
        steps.append(
            f"r{k} AS (SELECT *, (length({last}) - length(replace({last}, '{pattern}', '')))"
            f" // {len(pattern)} AS hit{k}, replace({last}, '{pattern}', '|') AS left{k} FROM {'base' if k == 0 else f'r{k - 1}'})"
        )
        last = f"left{k}"
        hits.append(f"hit{k}")
    names = ", ".join(f"CASE WHEN hit{k} > 0 THEN '{name}' END" for k, (name, _) in enumerate(RULES))
    return f"""
WITH cut AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE
    list_filter(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1\n', 'g'), '\\n+'), lambda s: regexp_matches(s, '(?i){needed}')) END AS parts
  FROM documents),
found AS (
  SELECT doc_id, list_filter(list_transform(parts, lambda s: MAP {{{known}}}[trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))]), lambda x: x IS NOT NULL) AS ids
  FROM cut),
base AS (SELECT doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS ids_text FROM found),
{', '.join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  CAST({' + '.join(hits)} AS BIGINT) AS n_matches,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))), ','), '') AS licenses
FROM r{len(RULES) - 1}
"""
