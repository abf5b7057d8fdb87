import re
import time

import pytest

from pharmalith.llm import secrets


@pytest.fixture(scope="module")
def model(spark):
    return secrets.standard_model(spark)


def test_held_out_accuracy(spark, model):
    held = secrets.score(secrets.example_findings(spark, 2000, seed=9), model).select("label", "score").collect()
    right = sum((r.score >= 0.5) == (r.label > 0) for r in held)
    assert right / len(held) > 0.95


def test_known_findings(spark, model):
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [f'x token = "{secret}" y', f"see commit {secret} in the log", "an internationalization-framework-component here", "https://example.com/assets/images/logo_large_version.png", "================================", "api_key: 9fK2mQz7Lx0pWv4RtY8uB3nD"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.score >= 0.5 for r in secrets.scan(df, model).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 5: True}


def brute(text):
    out = []
    for m in re.finditer(secrets.CANDIDATE, text or "", re.ASCII):
        own = m.group(1) or m.group().rstrip(".")
        if m.group(1) or len(own) >= 16:
            out.append((m.start(1) if m.group(1) else m.start(), own))
    return out


def test_candidates_match_brute_force(spark, table):
    found = sorted((r.id, r.start, r.candidate) for r in secrets.candidates(table("documents")).collect())
    assert found == sorted((r.doc_id, *x) for r in table("documents").collect() for x in brute(r.text)) and found


ODD = [
    "API_KEY=9fK2mQz7Lx0pWv4RtY8uB3nD", "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIK7MDENGbPxRfiCYzzzzKEY1.", "then token=abcd1234efgh5678ijkl. And", "pwd='s3cR3t_pw' password: required!", "key dGhpcyBpcyBhIHRlc3Q0Nzg5MQ== end dGhpcyBpcyBhIHRlc3Q0Nzg5MQ==x",
    "." * 40, "abcdefghijklmno..... abcdefghijklmnop.....", "é 日本 token: 12345 token: 123456 token: 1234567890123456", "=" * 30,
]


def test_names_stay_outside(spark, model):
    """In ``NAME=value`` the value alone is the candidate, without full stops, and the name stands before it."""
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = secrets.scan(rows, model).collect()
    assert sorted((r.id, r.start, r.candidate) for r in got) == sorted((k, *x) for k, t in enumerate(ODD) for x in brute(t))
    by = {(r.id, r.candidate): r for r in got}
    for key, name in (((0, "9fK2mQz7Lx0pWv4RtY8uB3nD"), "API_KEY="), ((1, "wJalrXUtnFEMIK7MDENGbPxRfiCYzzzzKEY1"), "AWS_SECRET_ACCESS_KEY="), ((2, "abcd1234efgh5678ijkl"), "then token="), ((3, "s3cR3t_pw"), "pwd='")):
        assert by[key].before == name and by[key].score >= 0.5
    assert by[1, "AWS_SECRET_ACCESS_KEY"].score < 0.5 and by[3, "required!"].score < 0.5


def test_many_candidates_in_one_text(spark):
    """A text of 64,000 candidates takes seconds; its places are right to the last one."""
    n = 64_000
    text = " ".join(f"abcdefghij{k:08d}" for k in range(n))
    began = time.time()
    rows = secrets.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("start").collect()
    assert time.time() - began < 20 and [r.start for r in rows] == [19 * k for k in range(n)]
    assert rows[-1].candidate == text[-18:] and rows[-1].after == "" and rows[5].before.endswith(text[19 * 4 : 19 * 5])


def test_planted_lines_of_the_table(spark, model):
    """Recall and precision on the table: tokens planted in documents are all found, and nothing else is."""
    got = secrets.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), model).collect()
    planted = [bool(re.search(r'(?i)token = "$', r.before)) for r in got]
    assert sum(planted) > 10 and [r.score >= 0.5 for r in got] == planted


def test_context_and_edges(spark, model):
    rows = [(1, None, "a"), (2, "", "a"), (3, "A" * 16, "b"), (4, "é" * 9 + "B" * 20 + " next " + "C" * 17, "c"), (4, "é" * 9 + "B" * 20 + " next " + "C" * 17, "c"), (5, "z" * 400_000, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted((r.id, r.start, len(r.candidate), r.before, r.after) for r in secrets.candidates(df).collect())
    one, two = (4, 9, 20, "é" * 9, " next " + "C" * 17), (4, 35, 17, "B" * 20 + " next ", "")
    assert got == [(3, 0, 16, "", ""), one, one, two, two, (5, 0, 400_000, "", "")]
    assert secrets.scan(df, model).count() == 6 and secrets.scan(df.limit(0), model).collect() == []


def test_no_python_in_the_plan(spark, table, model):
    plan = secrets.scan(table("documents"), model)._jdf.queryExecution().toString()
    assert not re.search("MapInArrow|ArrowEval|BatchEvalPython|MapInPandas", plan)
