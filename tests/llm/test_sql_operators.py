"""Operators that SQL can express: on the given tables, on odd rows, on planted cases."""

import re

import pytest

from tablesync.llm import licenses, linededup, mixing, queries, revisits
from tools.compare import canonical


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, small, duck, name):
    got, want = queries.QUERIES[name](spark, small).toPandas(), duck.execute(queries.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and canonical(got) == canonical(want)


@pytest.mark.parametrize(("operator", "sql"), [(licenses.scan, licenses.SQL), (linededup.dedupe_lines, linededup.SQL), (mixing.mix, mixing.SQL)])
def test_odd_documents(odd, none, over, operator, sql):
    got = operator(odd).toPandas()
    assert len(got) == 9 and canonical(got) == canonical(over(sql, documents=odd))
    assert operator(none).count() == 0


def test_license_places_and_labels(spark):
    texts = {
        1: "Released Under the  MIT-License. x\nunder the mit license",
        2: "licensed under the Apache License, Version 2.0",
        3: "CC BY-NC, cc_by_nc and xcc by nc",
        4: "This work is licensed under the GNU General Public License, version 3.",
        5: "under the mit licenses",
        6: "released into\nthe public\ndomain",
        7: "É under the mit license; under the mit license",
    }
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert (found[1].n_words, found[1].n_base, found[1].first_word, found[1].last_word) == (10, 2, 1, 6)
    assert (found[2].base_labels, found[2].first_word, found[2].score) == ("apache-2", 3, 1.0)
    assert (found[3].n_base, found[3].first_word, found[3].last_word) == (2, 0, 3)
    assert (found[4].base_labels, found[4].labels, found[4].first_word) == ("", "gpl-3", None)
    assert found[5].n_base == 0 and found[6].labels == "public-domain"  # a wrapped sentence
    assert found[7].n_base == 1  # a no-break space is no gap between words


def test_license_filters_lose_no_block(spark, table):
    """The filtered join finds what comparing every sentence with every template finds, at a lower threshold."""
    docs = table("documents")
    found = {(r.row, r.no, r.t) for r in licenses.matches(docs, licenses.vocabulary(licenses.phrases(docs)), containment=0.6).collect()}
    plain = set()
    from tablesync.llm.common import row_key

    for row, text in docs.select(row_key(docs), "text").collect():
        for no, block in enumerate(re.split("[.!?]+[ \t]+", text.replace("\n", " "))):
            words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in block.lower()).split()
            pairs = set(zip(words, words[1:], strict=False))
            for t, (template, _, must) in enumerate(licenses.TEMPLATES):
                need, (must, must_pairs) = template.split(), licenses._must(must)
                both = set(zip(need, need[1:], strict=False))
                if len(set(need) & set(words)) >= 0.6 * len(set(need)) and set(must) <= set(words) and {tuple(p.split()) for p in must_pairs} <= pairs and len(pairs & both) >= 0.6 * len(both):
                    plain.add((row, no, t))
    assert found == plain and plain


def test_license_kin_order_and_wrapping(spark, over):
    texts = {
        1: ("Licensed under CC BY 4.0.", "cc-by"),
        2: ("Licensed under the GNU General Public License", ""),  # no version, no kin
        3: ("a b c by 4 0 nc under d cc", ""),
        4: ("the public domain was entered into by many who were released from it", ""),
        5: ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that", "bsd"),
        6: ("(c) 2020 X. All rights reserved. Licensed under CC BY-SA 4", "all-rights-reserved,cc-by-sa"),
        7: ("Own words first. Released under the MIT License. Licensed under the GNU Lesser General Public License. More words", "lgpl,mit"),
        8: ("Permission is hereby granted, free of charge,\nto any person obtaining a copy of\nthis software and associated documentation files (the \"Software\")", "mit"),
        9: ("Licensed under CC BY-NC 4.0 and nothing else", "cc-by-nc"),
        10: ("This program is free: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    got = licenses.scan(docs)
    assert {r.doc_id: r.labels for r in got.collect()} == {i: label for i, (_, label) in texts.items()}
    assert canonical(got.toPandas()) == canonical(over(licenses.SQL, documents=docs))


PASSAGE = "one passage of well over fifty words " + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50))


def _own(i: int, n: int = 6) -> list[str]:
    return [" ".join(f"own{chr(97 + (i * 7 + k * 3 + j) % 26)}{chr(97 + (i + j * 5) % 26)}{chr(97 + (k + i) % 26)}" for j in range(12)) for k in range(n)]


def test_planted_passages_go_and_clean_lines_stay(spark, over):
    rows = [(i, "\n".join([*_own(i)[:3], PASSAGE, *_own(i)[3:]])) for i in range(8)]
    rows += [(10 + i, "\n".join([*_own(20 + i), f"Posted by user{i} on 2024-01-{i:02d} in the forum"])) for i in range(8)]
    rows += [(30, "\n".join(_own(50)))] + [(40 + i, "\n".join(_own(60))) for i in range(5)]  # clean; copies of a clean one
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.dedupe_lines(docs).collect()}
    for i in range(8):
        assert got[i].text == "\n".join(_own(i)) and got[i].n_dropped == 1
        assert got[10 + i].text == "\n".join(_own(20 + i))
    assert got[30].n_dropped == 0 and all(got[40 + i].n_dropped == 0 for i in range(5))
    assert canonical(linededup.dedupe_lines(docs).toPandas()) == canonical(over(linededup.SQL, documents=docs))


def test_line_dedup_keeps_columns(odd):
    out = linededup.dedupe(odd)
    assert out.columns == odd.columns and out.count() == odd.count()


def test_mix_meets_targets(spark):
    rows = [(i, " ".join(["w"] * (i % 17)), ["a", "b", "c", None][min(3, i % 9)]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    assert (got.taken <= 3 * got["size"]).all() and got.taken.sum() <= got["size"].sum()
    per = got.groupby("target").agg(taken=("taken", "sum"))
    assert all(abs(r.taken - t) <= 20 for t, r in per.iterrows())
    assert abs(got.drop_duplicates("source_size").target.sum() - got["size"].sum()) < 0.01
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert canonical(got) == canonical(again)


def test_mixed_keeps_what_is_taken(odd, none):
    out = mixing.mixed(odd)
    assert set(out.columns) == {*odd.columns, "first_slot"}
    assert out.where("taken <= 0").count() == 0 and out.count() > 0
    assert mixing.mixed(none).count() == 0


def test_revisits(spark):
    def row(i, url, ts, kind, tag=None, time=None, **headers):
        return i, url, ts, kind, tag, time, headers or None

    page = "http://www.Example.org:80/a/?b=2&utm_source=x&a=1#top"
    rows = [
        row(1, "https://example.org/a?a=1&b=2", 100, "response", '"x"', "m", etag='"x"', date="1", **{"content-length": "9"}),
        row(2, page, 90_000, "revisit", 'W/"x"', None, date="2", **{"content-length": "0"}),
        row(3, page, 100, "revisit", '"x"'),
        row(4, page, 90_001, "revisit", '"y"', "m"),
        row(5, page, 90_002, "revisit", None, "m"),
        row(6, page, 90_003, "revisit"),
        row(7, None, 90_004, "revisit", '"x"'),
        row(8, page, None, "revisit", '"x"'),
        row(9, "http://example.org/a?a=1&b=2", 90_002, "response", '"z"', "n"),
        row(10, "http://example.org/a?b=2&a=1", 90_002, "response", '"z"', "n2"),
        row(11, page, 90_010, "revisit", '"z"'),
    ]
    schema = "record_id long, url string, ts long, kind string, etag string, modified string, headers map<string,string>"
    got = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert {i: (r.refers_to, r.status) for i, r in got.items()} == {
        2: (1, "etag"), 3: (None, "no_response"), 4: (None, "mismatch"), 5: (1, "modified"), 6: (10, "unverified"),
        7: (None, "no_response"), 8: (None, "no_response"), 11: (10, "etag"),
    }
    assert got[2].headers == {"etag": '"x"', "date": "2", "content-length": "9"}
    assert got[2].canonical_url == "example.org/a?a=1&b=2"
    assert revisits.resolve(spark.createDataFrame([], schema)).count() == 0


def test_crawl_of_odd_pages(spark, over):
    pages = spark.createDataFrame([(1, None, None, "e"), (2, "http://a.b/c", "", "e"), (3, "no url", "x", "e"), (3, "no url", "x", "e")], "page_id long, url string, html string, headers string")
    assert canonical(revisits.resolved(pages).toPandas()) == canonical(over(revisits.SQL, pages=pages))
