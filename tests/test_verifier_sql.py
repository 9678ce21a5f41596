"""Short answers in the verifier's queries. Their SQL has no arm for the verifier's rules 3 and 4: a client's "No, never." is
no evidence for a positive value, and for no other without its question; a bare "Yeah." is none without its question. Here
the two rules are put into a copy of the SQL. Quotes are single ones in these queries, so the question is never cited."""

import duckdb
import pytest

from quillon import queries
from quillon.functions import text as T
from quillon.plans.verification import _list, _norm

TALK = [
    ("assistant", "Do you take any of these medicines every single day of the week, or not at all?"),
    ("user", "No, never any."),
    ("assistant", "No way."),
    ("user", "Yeah."),
    ("system", "Um, no. Not in the last years at all, as far as I can tell."),
    ("user", "Well no, nothing."),
    ("user", "I said none of that was ever said to me by them."),
    ("assistant", "So no one has asked."),
]


def short(q: str) -> tuple[str, str]:
    """SQL: normalised ``q`` is a negated short answer, and a bare affirmation."""
    n = f"len(string_split({q}, ' '))"
    negated = f"({q} <> '' AND {n} <= 5 AND regexp_matches({q}, '{T._opens_with(T.NEGATIONS)}'))"
    return negated, f"({q} <> '' AND {n} <= 4 AND regexp_matches({q}, '{T._opens_with(T.AFFIRMATIONS)}') AND list_has_all({_list(T.AFFIRMATION_WORDS)}, string_split({q}, ' ')))"


def with_rules(name: str) -> str:
    """The SQL of a query with rules 3 and 4."""
    if name == "a02_status_reasons":
        return f"SELECT status, reason, count(*) AS n FROM ({with_rules('verify_outputs')}) GROUP BY ALL"
    sql = queries.ORACLE_SQL[name]
    if name == "verify_outputs":
        negated, bare = short("q")
        last = "WHEN kind = 'one' AND speaker <> 'client' THEN 'speaker_mismatch' END AS reason FROM found"
        assert sql.count(last) == 1
        rules = f"WHEN speaker = 'client' AND part IN ('YES', 'A', 'B') AND kind <> 'prose' AND {negated} THEN 'negated_answer' WHEN speaker = 'client' AND ({negated} OR {bare}) THEN 'missing_question_context'"
        return sql.replace(last, last.replace("END AS reason", f"{rules} END AS reason"))
    # every answer of verify_types cites its own turn's first words
    quote = r"array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g'))[1:1000], ' ')[1:8], ' ')"
    negated, bare = short("q")
    fails = f"status = 'filled' AND role <> 'assistant' AND ({negated} OR {bare})"
    return f"""WITH c AS (SELECT conv_id || '-' || turn AS place, role, {_norm(quote)} AS q FROM conversations), x AS (SELECT v.*, role, q FROM ({sql}) v JOIN c ON place = substr(answer_id, position('-' IN answer_id) + 1))
SELECT answer_id, CASE WHEN {fails} THEN 'rejected' ELSE status END AS status,
CASE WHEN {fails} THEN CASE WHEN {negated} AND (answer_id LIKE 'often-%' OR answer_id LIKE 'which-%') THEN 'negated_answer' ELSE 'missing_question_context' END ELSE reason END AS reason, value FROM x"""


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """The folder of a small table of conversations, and a connection with it."""
    folder = str(tmp_path_factory.mktemp("talk"))
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [(c, t, *said) for c in range(60) for t, said in enumerate(TALK[c % 3 :] + TALK[: c % 3])])
    con.sql(f"COPY conversations TO '{folder}/conversations.parquet' (FORMAT parquet)")
    return folder, con


@pytest.mark.parametrize("name", ["verify_outputs", "a02_status_reasons", "verify_types"])
def test_short_answers(spark, made, name):
    folder, con = made
    got = queries.QUERIES[name](spark, folder)
    rows = sorted((tuple(map(str, r)) for r in got.collect()))

    def of(sql):
        want = con.sql(sql)
        order = [want.columns.index(c) for c in got.columns]
        return sorted(tuple(str(r[i]) for i in order) for r in want.fetchall())

    assert rows == of(with_rules(name)) != of(queries.ORACLE_SQL[name])
    at = got.columns.index("reason")
    assert {"negated_answer", "missing_question_context"} <= {r[at] for r in rows}
