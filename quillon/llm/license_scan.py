"""Licence scan by sentence rules.

Texts are cut into sentences twice, once at line ends and once across single line ends (licence texts
are often wrapped). Each sentence is normalised (ASCII letters and digits, lower case, single spaces)
and mapped to the identifier of a known licence sentence, if it is one; any other sentence of more than ``GAP_WORDS`` words is a gap, shorter ones (the number of a clause) part
nothing. What is left of a text is a sequence of identifiers and gaps; the licence rules, in their order, are looked for
in that sequence, so their sentences have to follow each other without a gap, and what a
rule has matched is gone for the rules after it. All of it is expressions on one row: nothing is
shuffled, and texts without any cue word are skipped (the cues are found from the table of sentences, so
that every sentence holds one). Sentences and rules are parameters.

Line ends may be any of line feed, carriage return or both, and any white space may follow a mark.

Nulls: a null text holds no licence; a null id stays null. Repeated rows give repeated results. A text
without licences gives no row. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.storage import read_table

#: Sentences of public licences and licence notices, by identifier.
SENTENCES = {
    "mit_notice": "Released under the MIT License",
    "mit_notice_2": "Licensed under the MIT License",
    "mit_notice_3": "This project is licensed under the MIT License",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit_condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as_is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "apache_notice": "Licensed under the Apache License, Version 2.0",
    "apache_notice_2": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache_use": "you may not use this file except in compliance with the License",
    "apache_copy": "You may obtain a copy of the License at",
    "gpl3_notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl3_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2_free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "bsd_head": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl_form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc_by_notice": "Licensed under CC BY 4.0",
    "cc_by_sa_notice": "Licensed under CC BY-SA 4.0",
    "cc_by_nc_notice": "Licensed under CC BY-NC 4.0",
    "cc_by_work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
}

#: The rules, first come first: a licence and the identifiers that have to follow each other.
RULES = [
    ("BSD-3-Clause", ["bsd_head", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_head", "bsd_source", "bsd_binary"]),
    ("MIT", ["mit_grant", "mit_condition", "as_is"]),
    ("MIT", ["mit_grant", "mit_condition"]),
    ("Apache-2.0", ["apache_notice_2", "apache_use", "apache_copy"]),
    ("GPL-3.0-or-later", ["gpl3_free", "gpl_hope"]),
    ("GPL-3.0-or-later", ["gpl3_free"]),
    ("GPL-2.0-or-later", ["gpl2_free", "gpl_hope"]),
    ("GPL-2.0-or-later", ["gpl2_free"]),
    ("GPL-3.0-only", ["gpl3_notice"]),
    ("ISC", ["isc_grant"]),
    ("MIT", ["mit_notice"]),
    ("MIT", ["mit_notice_2"]),
    ("MIT", ["mit_notice_3"]),
    ("Apache-2.0", ["apache_notice_2"]),
    ("Apache-2.0", ["apache_notice"]),
    ("MPL-2.0", ["mpl_form"]),
    ("CC-BY-4.0", ["cc_by_notice"]),
    ("CC-BY-4.0", ["cc_by_work"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_notice"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_notice"]),
    ("Unlicense", ["unlicense"]),
]

#: Longer sentences that no rule knows part what stands around them.
GAP_WORDS = 3
#: A sentence ends at marks before white space or the end of the text, and at line ends.
BY_LINE = r"[.!?:;]+(?:[ \n]+|$)|\n+"
ACROSS_LINES = r"[.!?:;]+(?:[ \n]+|$)|\n\n+"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known_sentences(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Normalised sentence to identifier; the sentences are cut like any text, their last part counts."""
    found = {}
    for name, sentence in sentences.items():
        for n, part in enumerate(p for p in re.split(ACROSS_LINES, sentence) if normal(p)):
            found[normal(part)] = name if n == 0 else f"{name}_{n}"
    return found


def cue(sentences: dict[str, str] = SENTENCES) -> str:
    """A pattern that all texts with a known sentence fit: words, one of which each sentence holds. The word that most
    sentences hold comes first, of equals the longest."""
    left, words = [set(s.split()) for s in known_sentences(sentences)], []
    while left:
        count = Counter(w for s in left for w in s)
        words.append(max(count, key=lambda w: (count[w] if len(w) > 5 else 0, len(w), w)))
        left = [s for s in left if words[-1] not in s]
    return "(?i)" + "|".join(words)


def rule_sequences(sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> list[tuple[str, str]]:
    """(licence, its identifiers as ``;a;;b;``); a sentence that is cut counts with all its parts."""
    parts: dict[str, list[str]] = {}
    for name, sentence in sentences.items():
        n = sum(1 for p in re.split(ACROSS_LINES, sentence) if normal(p))
        parts[name] = [name if k == 0 else f"{name}_{k}" for k in range(n)]
    return [(licence, "".join(f";{p};" for i in ids for p in parts[i])) for licence, ids in rules]


def plain_breaks(text: Column) -> Column:
    """Line feeds for all line ends, and blanks for all other white space, as the cuts expect them."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[^\S\n]", " ")


def sequence(text: Column, pattern: str, known: Column) -> Column:
    """The identifiers of the known sentences in text order, as ``;a;;b;``, with ``~`` for each gap; without any known
    sentence it is empty."""
    sentences = F.split(text, pattern)
    plain = F.transform(sentences, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    gap = lambda s: F.when(F.size(F.split(s, " ")) > GAP_WORDS, "~").otherwise("")
    marks = F.transform(plain, lambda s: F.coalesce(F.concat(F.lit(";"), F.element_at(known, s), F.lit(";")), gap(s)))
    found = F.array_join(marks, "")
    return F.when(found.contains(";"), found).otherwise("")


def matches(identifiers: Column, rules: Column) -> Column:
    """(licence, n) of each rule that is found, in the order of the rules; what a rule matches is gone for the others."""
    start = F.struct(identifiers.alias("left"), F.array().cast("array<struct<license:string,n:bigint>>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        left = F.replace(state["left"], rule["ids"], F.lit("|"))
        n = ((F.length(state["left"]) - F.length(left)) / (F.length(rule["ids"]) - 1)).cast("bigint")
        more = F.concat(state["found"], F.array(F.struct(rule["license"].alias("license"), n.alias("n"))))
        return F.struct(left.alias("left"), F.when(n > 0, more).otherwise(state["found"]).alias("found"))

    return F.aggregate(rules, start, step)["found"]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """One row for each document and licence found: doc_id, license, n_matches (the larger count of both cuts)."""
    known = F.create_map(*[F.lit(x) for pair in known_sentences(sentences).items() for x in pair])
    table = F.array(*[F.struct(F.lit(licence).alias("license"), F.lit(ids).alias("ids")) for licence, ids in rule_sequences(sentences, rules)])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(cue(sentences)))
    for cut, pattern in (("by_line", BY_LINE), ("across", ACROSS_LINES)):
        rows = rows.withColumn(cut, sequence(plain_breaks(F.col("text")), pattern, known))
    rows = rows.drop("text").filter("by_line <> '' or across <> ''")
    rows = rows.withColumns({cut: matches(F.col(cut), table) for cut in ("by_line", "across")})
    total = lambda cut, licence: F.aggregate(F.filter(cut, lambda x: x["license"] == licence), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    found = F.array_distinct(F.transform(F.concat("by_line", "across"), lambda x: x["license"]))
    found = rows.select("doc_id", "by_line", "across", F.explode(found).alias("license"))
    return found.select("doc_id", "license", F.greatest(total("by_line", F.col("license")), total("across", F.col("license"))).alias("n_matches"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """The same rules as DuckDB SQL."""
    known = ", ".join(f"({_quoted(s)}, {_quoted(i)})" for s, i in known_sentences().items())
    sql = f"WITH known(sentence, ident) AS (VALUES {known})"
    for cut, pattern in (("by_line", BY_LINE), ("across", ACROSS_LINES)):
        sql += f""", {cut}_s AS (
  SELECT doc_id, generate_subscripts(s, 1) AS k, unnest(s) AS x FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[^\\S\\n]', ' ', 'g'), {_quoted(pattern)}) AS s FROM documents)
), {cut}_0 AS (
  SELECT doc_id, string_agg(CASE WHEN ident IS NOT NULL THEN ';' || ident || ';' WHEN len(string_split(plain, ' ')) > {GAP_WORDS} THEN '~' ELSE '' END, '' ORDER BY k) AS q
  FROM (SELECT *, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS plain FROM {cut}_s) LEFT JOIN known ON sentence = plain GROUP BY doc_id
)"""
        for k, (_, ids) in enumerate(rule_sequences()):
            sql += f", {cut}_{k + 1} AS (SELECT doc_id, replace(q, {_quoted(ids)}, '|') AS q, (length(q) - length(replace(q, {_quoted(ids)}, '|'))) // {len(ids) - 1} AS n FROM {cut}_{k})"
    parts = [f"SELECT doc_id, '{cut}' AS cut, {_quoted(licence)} AS license, n FROM {cut}_{k + 1}" for cut in ("by_line", "across") for k, (licence, _) in enumerate(rule_sequences())]
    each = " UNION ALL ".join(parts)
    return f"{sql} SELECT doc_id, license, max(n)::BIGINT AS n_matches FROM (SELECT doc_id, cut, license, sum(n) AS n FROM ({each}) GROUP BY ALL) GROUP BY doc_id, license HAVING max(n) > 0"
