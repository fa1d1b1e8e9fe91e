from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from plumbline.llm import license_texts, licenses, queries


def scanned(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r for _, r in sorted((r["doc_id"], r) for r in licenses.scan(docs, **options).collect())]


def test_whole_texts_in_other_clothes(spark):
    texts = [body for _, _, body in license_texts.TEXTS]
    want = [k for k, _, _ in license_texts.TEXTS]
    assert [r["license_id"] for r in scanned(spark, texts)] == want
    dressed = [f"{title.upper()}\n\nCopyright (c) 2021-2024 A. Holder, Inc.\n(C) 2020 Other\nAll rights reserved.\n\n" + body.replace(" ", "  \t").replace(",", " ;").replace("\n", "\r\n") for _, title, body in license_texts.TEXTS]
    assert [r["license_id"] for r in scanned(spark, dressed)] == want
    spelled = [b.replace("sublicense", "sub-licence").replace("NONINFRINGEMENT", "non-infringement").replace("acknowledgment", "acknowledgement") for b in texts]
    assert [r["license_id"] for r in scanned(spark, spelled)] == want
    other = [b.replace("free of charge", "for a charge").replace("with or without", "without").replace("freely", "rarely").replace("Anyone", "Nobody") for b in texts]
    assert [r["license_id"] for r in scanned(spark, other)] == [None] * len(want)


def test_a_line_wrapped_before_copyright_notice_stays(spark):
    body = license_texts.TEXTS[4][2].replace("above copyright notice", "above\ncopyright notice")
    assert scanned(spark, [body])[0]["license_id"] == "BSD-2-Clause"


def test_notices_and_own_tables(spark):
    rows = scanned(spark, ["words\n  Released under the MIT license!\nmore", "licensed under the apache licence version 2.0\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", "All rights reserved.", "Licensed under the Apache License, Version 2.0. And more", None, ""])
    assert [(r["notices"], r["n_notices"]) for r in rows] == [("MIT", 1), ("Apache-2.0,CC-BY-NC-4.0", 3), ("LicenseRef-all-rights-reserved", 1), ("", 0), ("", 0), ("", 0)]
    assert rows[4]["digest"] == rows[5]["digest"] and rows[4]["license_id"] is None
    known = spark.createDataFrame([("B", "My own licence."), ("A", "my OWN license"), ("C", ""), ("D", None)], "license_id string, text string")
    assert [r["license_id"] for r in scanned(spark, ["MY OWN LICENCE", "", None, "mine"], known=known)] == ["A", None, None, None]


def test_op1_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(licenses.oracle_sql())
    got = queries.op1_license_scan(spark, sf).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
    assert any(r["n_notices"] for r in got)


def test_bears_odd_rows_and_stays_native(spark, odd_docs, empty_docs):
    assert licenses.scan(empty_docs).count() == 0
    data = odd_docs.withColumn("digest", F.lit("x")).withColumn("line", F.lit(1)).withColumn("license_id", F.lit("y"))
    assert licenses.scan(data).count() == odd_docs.count()
    plan = licenses.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_copyright_lines_in_many_forms(spark):
    body = license_texts.TEXTS[0][2]
    heads = ["© 2024 Jane Doe\n", "Copyright © 2024 Jane Doe\n", "Copyright Jane Doe 2024\n", "Portions copyright 2020 X\n", "Copyright 2020 X\r", "Copyright (c) 2020 X\r\rAll rights reserved.\r\r", "Copyright 2020-2024 by X, Y\n",
             " * © Jane Doe, 2019\n", "Copyright by Jane Doe\n", "SPDX-FileCopyrightText: 2020 X\n", "(c) 2020 X. All rights reserved.\n"]
    assert [r["license_id"] for r in scanned(spark, [h + body for h in heads])] == ["MIT"] * len(heads)
    assert scanned(spark, ["copyright holders of 2020 things\n" + body])[0]["license_id"] is None


def test_long_licences(spark):
    """By digest; held against the texts where the system has them."""
    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    there = {k: v for k, v in names.items() if (folder / k).exists()}
    texts = [(folder / k).read_text() for k in there]
    other = [t.upper().replace("\n", " \r\n\t") for t in texts]
    assert [r["license_id"] for r in scanned(spark, texts + other)] == [*there.values()] * 2
    assert [r["license_id"] for r in scanned(spark, [t.replace(" the ", " teh ", 1) for t in texts])] == [None] * len(there)
    assert set(names.values()) | {"BSL-1.0"} <= {k for k, _ in license_texts.DIGESTS} and len({d for _, d in license_texts.DIGESTS}) == len(license_texts.DIGESTS)
