import random
import re

import pyarrow as pa

from pharmalith.llm import licenses
from pharmalith.llm.bytewords import text_buffer

WORDS = [f"v{k}" for k in range(500)]


def norm(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs):
    """(doc, license) where one whole template stands word for word, but not within a longer one of another license."""
    found = set()
    for doc_id, text in docs:
        flat = " " + " ".join(norm(text)) + " "
        spans = []
        for name, template in licenses.TEMPLATES:
            wanted = " " + " ".join(norm(template)) + " "
            spans += [(m.start(), m.start() + len(wanted), name) for m in re.finditer(f"(?={re.escape(wanted)})", flat)]
        found |= {(doc_id, name) for a, b, name in spans if not any(x <= a and b <= y and (x, y) != (a, b) and other != name for x, y, other in spans)}
    return found


def scan(spark, docs):
    return {(r.id, r.license): r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_planted_templates_are_found(spark):
    """Every template at many places of many texts; recall against brute force is whole.

    The two-clause text near the third clause is the three-clause license.
    """
    rng, docs = random.Random(2), []
    for k in range(300):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(400))]
        for _, template in rng.sample(licenses.TEMPLATES, rng.randrange(3)):
            words.insert(rng.randrange(len(words) + 1), template)
        docs.append((k, " ".join(words)))
    want, got = brute(docs), scan(spark, docs)
    want -= {(d, "BSD-2-Clause") for d, name in want if name == "BSD-3-Clause"}
    assert want <= set(got) and all(r.containment >= 0.8 for r in got.values())


def test_whole_table(spark, table):
    docs = [(r.doc_id, r.text) for r in table("documents").collect()]
    got = {(r.doc_id, r.license) for r in licenses.op10(spark, table("documents")).collect()}
    assert brute(docs) <= got and {d for d, _ in got} == {d for d, t in docs if re.search(r"(?i)licen[sc]ed? ", t) or "License" in t} | {d for d, _ in brute(docs)}


def test_positions_and_changed_words(spark):
    full = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 300)
    words = full.split()
    words[40] = "CHANGED"
    docs = [(1, "one two " + "Released under the MIT License." + " three"), (2, " ".join(words)), (3, "licensed under the"), (4, None), (5, ""), (6, "v1 " * 150_000 + "Licensed under CC BY-NC 4.0."), (7, " ".join(words[:30]))]
    got = scan(spark, docs)
    assert {k for k in got} == {(1, "MIT"), (2, "MIT"), (6, "CC-BY-NC-4.0")}
    assert (got[1, "MIT"].first_word, got[1, "MIT"].last_word, got[1, "MIT"].containment) == (2, 6, 1.0)
    assert 0.8 <= got[2, "MIT"].containment < 1


def test_rows(spark):
    df = spark.createDataFrame([(1, "Licensed under CC BY 4.0.", "x"), (1, "Licensed under CC BY 4.0.", "x"), (None, "Licensed under CC BY 4.0.", "x")], "doc_id long, text string, license string")
    assert sorted((r.doc_id or 0) for r in licenses.op10(spark, df).collect()) == [0, 1, 1]
    assert licenses.op10(spark, df.limit(0)).collect() == []
    assert {r.license for r in licenses.scan(df, [("none", ""), ("short", "cc by"), ("whole", "licensed under cc by 4 0")]).collect()} == {"whole"}


def test_levels_hold_every_run():
    for n in range(1, 400):
        length, step = licenses.level_of(n)
        assert all(any(s <= at and at + n <= s + length for s in range(0, at + 1, step)) for at in range(3 * length)[:50]) and (n == 1 or n >= length * 3 / 8)


def test_windows_cross_no_documents():
    index = licenses.Index.build(licenses.TEMPLATES)
    data, offsets = text_buffer(pa.array(["x y Released under the MIT", "License. z"]))
    from pharmalith.llm.bytewords import ALNUM, shingle_hashes, words_of

    doc = words_of(data, offsets, ALNUM)
    assert index.search(*shingle_hashes(doc.hashes(), doc.rows, 5)) == {}
