"""The exact set of licenses per document, of license texts as documents carry them rather than of TEMPLATES."""

from pharmalith.llm import licenses

HEADER = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
LIBRARY = HEADER.replace("program", "library")


def found(spark, texts):
    got = {k: set() for k in range(len(texts))}
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r.id].add(r.license)
    return [got[k] for k in range(len(texts))]


def test_versions_and_names_are_told_apart(spark):
    line = "This work is licensed under the GNU General Public License, version {}."
    cases = [
        (line.format(3), {"GPL-3.0"}), (line.format(2), {"GPL-2.0"}), (line.format(2) + "\n" + line.format(3), {"GPL-2.0", "GPL-3.0"}), (line.format(7), set()),
        (HEADER.format("", 2), {"GPL-2.0"}), (HEADER.format("", 3), {"GPL-3.0"}), (HEADER.format("Affero ", 3), {"AGPL-3.0"}),
        (LIBRARY.format("Lesser ", "2.1"), {"LGPL-2.1"}), (LIBRARY.format("Lesser ", 3), {"LGPL-3.0"}),
        (HEADER.format("Affero ", 3) + "\n" + line.format(2), {"AGPL-3.0", "GPL-2.0"}), (HEADER.format("", 3).replace("of the License, or", "of this License, or"), {"GPL-3.0"}),
    ]
    assert found(spark, [f"one two three.\n{t}\nfour five six" for t, _ in cases]) == [want for _, want in cases]


def test_short_notice(spark):
    cases = [
        ("one two three four five six.\nAll rights reserved.\nseven eight nine", {"Proprietary"}), ("Copyright 2020 by some one, all rights reserved", {"Proprietary"}), ("All rights reserved.", {"Proprietary"}),
        ("w1 w2 w3 w4 w5 All rights reserved by law are listed here", set()), ("w1 w2 w3 w4 w5 all rights", set()), ("reserved. w1 w2 w3 w4 w5", set()), ("all rights reserved-or-not in w1 w2", set()),
    ]
    assert found(spark, [t for t, _ in cases]) == [want for _, want in cases]


#: The license lines of the test data.
LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "All rights reserved.": "Proprietary",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


def test_license_lines_of_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    want = {(r.doc_id, name) for r in rows.collect() for line, name in LINES.items() if line in (r.text or "").split("\n")}
    assert {(r.doc_id, r.license) for r in licenses.op10(spark, rows).collect()} == want


def test_a_license_that_is_part_of_another(spark, tmp_path):
    two, three = (max((t for n, t in licenses.TEMPLATES if n == name), key=len) for name in ("BSD-2-Clause", "BSD-3-Clause"))
    numbered = three.replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in").replace("Neither", "3. Neither")
    assert found(spark, [f"x y z. {t} p q r" for t in (two, three, numbered, f"{two} {'words between ' * 200} {three}")]) == [{"BSD-2-Clause"}, {"BSD-3-Clause"}, {"BSD-3-Clause"}, {"BSD-2-Clause", "BSD-3-Clause"}]
    whole = " ".join(f"clause{k} of the long license text" for k in range(900))
    (tmp_path / "Long-1.0.txt").write_text(whole)
    rows = spark.createDataFrame([(1, f"before it {whole} and after"), (2, whole[:6000])], "doc_id long, text string")
    assert [(r.id, r.license) for r in licenses.scan(rows, licenses.templates_from(tmp_path)).collect()] == [(1, "Long-1.0")]
