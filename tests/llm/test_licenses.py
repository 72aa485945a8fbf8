from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelloom.llm import licenses
from panelloom.llm.queries import QUERIES
from tests.llm.helpers import DOCS, docs, rows

FILLER = ["the river runs past the old mill and into the lake beyond the hill", "a long winter kept the farmers at home until late in the spring", "few people knew the way through the marsh after dark"]


@pytest.fixture(scope="module")
def scanned(spark):
    """Every template alone, inside other words, and cut short; talk about licences; odd rows."""
    table, want, i = [], {}, 100
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            for text in (t, f"{FILLER[0]}\n{t}\n{FILLER[1]}", f"{t} {FILLER[2]}", t.upper()):
                table.append((i, text))
                want[i] = family
                i += 1
    quiet = [(1, None), (2, ""), (3, "\n\n"), (4, "nothing here"), (5, "a b c " * 5_000)]
    talk = [(10, "You need a license to fish in the lake."), (11, "Copyright laws differ."), (12, "The warranty of this car ended last year."), (13, " ".join(FILLER * 40) + " license " + " ".join(FILLER * 40))]
    table += quiet + talk + [(14, "\n".join(FILLER) + f" {k}") for k in range(300)] + [(15, "Released under the MIT License."), (15, "Released under the MIT License."), (None, "Released under the MIT License.")]
    df = docs(spark, table).withColumns({"grams": F.lit(1), "line": F.lit(2), "label": F.lit("x"), "features": F.lit(3)})
    return rows(licenses.scan_licenses(df)), want


def test_families_are_found(scanned):
    got, want = scanned
    found = {}
    for r in got:
        if r["confirmed"]:
            found.setdefault(r["doc_id"], set()).add(r["family"])
    gated = {r["doc_id"] for r in got}
    right = sum(found.get(i) == {f} for i, f in want.items() if i in gated)
    assert right >= 0.95 * sum(i in gated for i in want)
    assert all(f == {want[i]} for i, f in found.items() if i in want)


def test_talk_about_licences_is_unknown(scanned):
    got, _ = scanned
    assert all(r["family"] == "unknown" and not r["confirmed"] for r in got if r["doc_id"] in (10, 11, 12, 13))
    assert not [r for r in got if r["doc_id"] in (1, 2, 3, 4, 5)]
    assert len([r for r in got if r["doc_id"] == 13]) >= 1


WRAPPED = {
    "MIT": (
        "", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n"
        "in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell",
    ),
    "GPL-3.0": (
        " * ", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
        "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    ),
    "BSD-3-Clause": ("# ", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
}


def test_wrapped_notices(spark):
    texts = [(i, "\n".join(mark + x for x in ["Copyright 2020 the authors", "", *body.split("\n"), "", "end"])) for i, (mark, body) in enumerate(WRAPPED.values())]
    got = rows(licenses.scan_licenses(docs(spark, texts + [(100 + k, f"{x} {k}\n{x}") for k in range(100) for x in FILLER])))
    assert {(r["doc_id"], r["family"]) for r in got if r["confirmed"]} == set(enumerate(WRAPPED))


def test_repeated_and_nameless_rows(scanned):
    got, _ = scanned
    assert [r["family"] for r in got if r["doc_id"] == 15] == ["MIT", "MIT"] and [r["family"] for r in got if r["doc_id"] is None] == ["MIT"]


def test_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_plan_has_no_python(spark):
    plan = licenses.passages(docs(spark, ["a license"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_finds_the_lines_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    want = {(r.doc_id, lines[x]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() for x in r.text.split("\n") if x in lines}
    got = {(r["doc_id"], r["family"]) for r in rows(QUERIES["op6_license_scan"](spark, folder)) if r["confirmed"]}
    assert got == want
