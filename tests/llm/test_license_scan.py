import re

from quillon.llm import license_scan as ls


def test_known_sentences_hold_a_cue():
    for name, sentence in ls.SENTENCES.items():
        parts = [p for p in re.split(ls.ACROSS_LINES, sentence) if ls.normal(p)]
        assert all(re.search(ls.cue(), p) for p in parts), name
    assert ls.cue().count("|") < 10


def test_a_table_of_hundreds_of_sentences(spark):
    """A table of one's own: sentences without any of the usual words are found, and rules keep their order."""
    sentences = {f"s{i}": f"Clause number {i} of the {['alpha', 'beta', 'gamma'][i % 3]} terms; {i} applies" for i in range(300)}
    rules = [(f"L{i}", [f"s{i}", f"s{i + 1}"]) for i in range(0, 298, 2)] + [(f"M{i}", [f"s{i}"]) for i in range(300)]
    docs = [(1, "x. " + sentences["s4"] + ". " + sentences["s5"] + ".\n" + sentences["s7"]), (2, sentences["s5"].upper() + ". " + sentences["s4"]), (3, "clause number of the terms")]
    got = sorted(tuple(r) for r in ls.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), sentences=sentences, rules=rules).collect())
    assert got == [(1, "L4", 1), (1, "M7", 1), (2, "M4", 1), (2, "M5", 1)]


def test_rules_in_order(spark):
    S = ls.SENTENCES
    bsd = f"{S['bsd_head']}:\n\n1. {S['bsd_source']}.\n2. {S['bsd_binary']}."
    texts = [
        (1, "Hello.\nReleased under the MIT License.\nBye"),
        (2, bsd), (3, bsd.replace("1. ", "").replace("2. ", "") + f"\n{S['bsd_endorse']}."),
        (4, "Permission is hereby granted. Nothing else."),
        (5, "this program is free software; you can redistribute it and/or modify\nit under the terms of the gnu general public license as published by\nthe Free Software Foundation; either version 2 of the License, or (at your option)\nany later version."),
        (6, "Licensed under CC BY-NC 4.0.\nx\nLicensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."),
        (7, None), (8, ""), (None, "Licensed under CC BY 4.0"), (9, "The license is lost."), (6, "Released under the MIT License."),
    ]
    docs = spark.createDataFrame([(*t, "x") for t in texts], "doc_id bigint, text string, license string")
    got = sorted(((r.doc_id or -1), r.license, r.n_matches) for r in ls.scan(docs).collect())
    # the numbers of clauses part nothing
    assert got == [
        (-1, "CC-BY-4.0", 1), (1, "MIT", 1), (2, "BSD-2-Clause", 1), (3, "BSD-3-Clause", 1), (5, "GPL-2.0-or-later", 1),
        (6, "Apache-2.0", 1), (6, "CC-BY-NC-4.0", 2), (6, "MIT", 1),
    ]
    assert ls.scan(docs.limit(0)).count() == 0


def test_line_ends_and_white_space(spark):
    """Wrapped texts give the same with line feeds, carriage returns, both, and tabs after marks."""
    S = ls.SENTENCES
    wrap = lambda x: "\n".join(__import__("textwrap").wrap(x, 60))
    mit = f"{wrap(S['mit_grant'])}:\n\n{wrap(S['mit_condition'])}.\n\n{wrap(S['as_is'])}."
    gpl = f"{wrap(S['gpl2_free'])}.\n\n{wrap(S['gpl_hope'])}.\n"
    texts = [(k, form(t)) for k, (t, form) in enumerate((t, f) for t in (mit, gpl) for f in (
        lambda x: x, lambda x: x.replace("\n", "\r\n"), lambda x: x.replace("\n", "\r"), lambda x: x.replace(".\n", ".\t\n").replace(":\n", ":\t\n").replace("; ", ";\t")))]
    got = sorted((r.doc_id, r.license, r.n_matches) for r in ls.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect())
    assert got == [(k, "MIT" if k < 4 else "GPL-2.0-or-later", 1) for k in range(8)]


def test_gaps_part_a_rule(spark):
    """Sentences of a rule with another one between them aren't that rule; a short one doesn't matter."""
    S = ls.SENTENCES
    texts = [
        (1, f"{S['mit_grant']}. This is an unrelated sentence. {S['mit_condition']}."), (2, f"{S['mit_grant']}. Note well. {S['mit_condition']}."),
        (3, f"{S['gpl2_free']}. Something else stands here today. {S['gpl_hope']}."), (4, "An unrelated sentence with the license in it. Nothing more than that here."),
    ]
    got = sorted(tuple(r) for r in ls.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect())
    assert got == [(2, "MIT", 1), (3, "GPL-2.0-or-later", 1)]
