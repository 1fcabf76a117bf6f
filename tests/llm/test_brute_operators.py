"""Operators beyond SQL against plain Python versions, odd rows and planted cases."""

import hashlib
import random
from collections import Counter
from itertools import product
from zlib import crc32

import numpy as np
import pytest

from tablesync.llm import common, components, decontaminate, fingerprints, langid, neardup, pages, quality, queries
from tests.llm import brute


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


# near-duplicates


def test_near_duplicates_match_all_pairs(spark, small, table):
    got = [tuple(r) for r in queries.QUERIES["op3_near_duplicates"](spark, small).collect()]
    assert by_id(got) == by_id(brute.near_duplicates(texts(table("documents"))))


def test_near_duplicates_of_odd_rows(odd, none):
    got = [tuple(r) for r in neardup.near_duplicates(odd).collect()]
    assert by_id(got) == by_id(brute.near_duplicates(texts(odd)))
    assert neardup.near_duplicates(none).count() == 0


def test_links_connect_exactly_what_two_bits_connect(spark):
    rng = random.Random(7)
    prints = set()
    for _ in range(12):  # chains and clouds of fingerprints a few bits apart
        p = rng.getrandbits(64)
        for _ in range(25):
            prints.add(p)
            for _ in range(rng.choice([1, 1, 2, 2, 3])):
                p ^= 1 << rng.randrange(64)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = components.components(neardup.links(spark.createDataFrame(signed, "fp long")))
    got = {}
    for node, root in found.collect():
        got.setdefault(root, set()).add(node & (2**64 - 1))
    want = {}
    for node, root in brute.joined(prints, [(a, b) for a, b in product(prints, prints) if a < b and (a ^ b).bit_count() <= 2]).items():
        want.setdefault(root, set()).add(node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


@pytest.mark.parametrize("busy", [1, 20, 1 << 20])
def test_segment_tables_find_all_pairs_also_under_busy_values(spark, monkeypatch, busy):
    """300 fingerprints that share one segment, or differ in few of its bits, among others; whatever counts as busy."""
    monkeypatch.setattr(neardup, "BUSY", busy)
    rng = random.Random(11)
    prints = {rng.getrandbits(64) for _ in range(50)}
    for shift in (0, 32):
        shared, seeds = rng.getrandbits(32) << shift, [rng.getrandbits(32) for _ in range(25)]
        for _ in range(300):
            p = shared | rng.choice(seeds) << (32 - shift)
            for _ in range(rng.randrange(4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints |= {0, 1, 1 << 63, 2**64 - 1, 2**64 - 2}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in neardup.links(spark.createDataFrame(signed, "fp long")).collect()]
    want = {frozenset(p) for p in product(prints, prints) if p[0] < p[1] and (p[0] ^ p[1]).bit_count() <= 2}
    assert {frozenset(p) for p in got} == want and len(want) > 300


def test_a_large_busy_value_gives_all_its_links(spark):
    """5,000 fingerprints under one value of the first segment: 12.5 million pairs."""
    rng = np.random.default_rng(12)
    low = np.unique(np.concatenate((rng.integers(0, 1 << 32, 4_990), [5, 6, 7, 4, 1 << 31])))
    found = neardup.links(spark.createDataFrame([(int(x) | 7 << 32,) for x in low], "fp long")).collect()
    want = {(a, b) for x, a in enumerate(low) for b in low[x + 1 :][np.bitwise_count(low[x + 1 :] ^ a) <= 2]}
    assert {(a & (2**32 - 1), b & (2**32 - 1)) for a, b in found} == want and len(found) == len(want) > 6


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(400)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5000), (1001, 1000)]
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    groups = {}
    for node, root in got:
        groups.setdefault(root, set()).add(node)
    assert sorted(map(len, groups.values())) == [301, 401]


def test_one_of_each_group_stays(odd, spark):
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect())
    assert [i for _, i in ids] == [1, 3, 4, 6, None]


# benchmark decontamination


def tiles_of(a, b, size=5):
    x, y = (decontaminate.seeds([w.encode() for w in t], size) for t in (a, b))
    at = np.flatnonzero(np.isin(x, y))
    return decontaminate.tile(at, x[at].view(np.int64), y.view(np.int64), size) if len(at) else []


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
@pytest.mark.parametrize("letters", ["a", "ab", "abcd"])
def test_tiles_match_the_textbook(monkeypatch, piece, letters):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(5, 40))] for _ in range(2))
        found = tiles_of(a, b)
        assert sum(t[0] for t in found) == brute.tiled(a, b)
        assert all(a[d : d + n] == b[i : i + n] for n, i, d in found)
        for side in (1, 2):
            taken = [t[side] + k for t in found for k in range(t[0])]
            assert len(taken) == len(set(taken))
        x, y = (decontaminate.seeds([w.encode() for w in t]) for t in (a, b))
        assert sum(t[0] for t in found) <= decontaminate.reachable(x, y, 5)


def test_repetitive_texts_hold_passages_not_pairs(monkeypatch):
    """One phrase over and over: 4 million pairs of positions lie on 12,000 diagonals at most."""
    most, plain = [], decontaminate._passages

    def counted(*args):
        found = plain(*args)
        most.append(len(found))
        return found

    monkeypatch.setattr(decontaminate, "_passages", counted)
    phrase = ["one", "phrase", "again", "and", "again"]
    found = tiles_of(phrase * 2_000, phrase * 400)
    assert [t[0] for t in found] == [2_000] and max(most) <= 12_000
    assert sum(t[0] for t in tiles_of(["no"] * 10_000, ["no"] * 2_000)) == 2_000
    rng = random.Random(4)
    a, b = ([rng.choice("ab") for _ in range(n)] for n in (500, 150))
    assert sum(t[0] for t in tiles_of(a, b)) == brute.tiled(a, b)


def test_short_items_are_found_where_all_of_them_stands(spark):
    bench = spark.createDataFrame([(1, "what is two plus"), (2, "Seldom!"), (3, "a b"), (4, " . "), (5, "one two three four five")], "item_id long, text string")
    rows = [(1, "so what is two plus two"), (2, "what is two and plus"), (3, "it is seldom so"), (4, "b a"), (5, "x A, b; a b"), (6, "one two three four"), (7, "zero one two three four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.contaminated(docs, bench).select("doc_id", "item_id", "n_words", "n_tiles", "matched").collect())
    assert got == [(1, 1, 4, 1, 4), (3, 2, 1, 1, 1), (5, 3, 2, 1, 2), (7, 5, 5, 1, 5)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [2, 4, 6]


def test_contamination_matches_all_pairs(spark, small, table):
    got = {(r.doc_id, r.item_id, r.matched) for r in queries.QUERIES["op5_decontaminate"](spark, small).collect()}
    items = [(r.item_id, brute.words(r.text)) for r in table("benchmark").collect()]
    want = set()
    for i, text in texts(table("documents")):
        a = brute.words(text)
        seeds = {tuple(a[k : k + 5]) for k in range(len(a) - 4)}
        for item, b in items:
            if any(tuple(b[k : k + 5]) in seeds for k in range(len(b) - 4)):
                n = brute.tiled(a, b)
                if n / len(b) >= decontaminate.COVERAGE:
                    want.add((i, item, n))
    assert got == want and got


def test_reordered_passages_are_found_and_clean_texts_stay(spark, odd, none):
    item = [f"word{chr(97 + i)}" for i in range(24)]
    bench = spark.createDataFrame([(1, " ".join(item), "x"), (2, None, "x"), (3, "too few words", "x"), (1, " ".join(item), "x")], "item_id long, text string, seed string")
    moved = "before " + " ".join(item[12:]) + " between " + " ".join(item[:12]) + " after"
    rows = [(1, moved.upper()), (2, " ".join(item[:15])), (3, "nothing of it"), (4, " ".join(item)), (4, " ".join(item)), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_tiles, r.matched) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(1, 1, 2, 24), (4, 1, 1, 24)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [2, 3, 5]
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 9
    assert decontaminate.clean(none, bench).count() == 0
    assert decontaminate.clean(odd, bench.limit(0)).count() == 9


# fingerprints


def test_fingerprints_match_pairs_in_order(spark, small, table):
    got = {r.doc_id: r for r in queries.QUERIES["op6_fingerprints"](spark, small).collect()}
    docs = sorted(texts(table("documents")), reverse=True)
    prints = {i: fingerprints.fingerprint(t) for i, t in docs}
    assert len(got) == len(docs)
    for (i, text), (nxt, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        cut = len(text) // 3
        new = text[: len(text) - cut] + following[:cut]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert got[i].fingerprint == "".join(f"{p & (2**64 - 1):016x}" for p in prints[i])
        apart = sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(prints[i], prints[nxt], strict=True))
        assert got[i].near_next == 1 - apart / 128
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.95


def test_ends_of_ranges_are_paired(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    docs = [(i, f"text {i} " * (i % 5 + 1)) for i in range(1, 90)]
    found = fingerprints.paired(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    order = sorted(docs, reverse=True)
    want = {i: hashlib.sha256(fingerprints.edited(t, n).encode()).hexdigest() for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True)}
    assert {r.doc_id: r.edited_sha256 for r in found} == want and len(found) == len(docs)


def test_fingerprints_of_odd_rows(odd, none):
    got = fingerprints.fingerprints(odd).collect()
    assert len(got) == 9 and len({r.fingerprint for r in got if r.n_chars == 37}) == 1
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 5)} == {"0" * 32}
    assert fingerprints.fingerprints(none).count() == 0
    assert fingerprints.fingerprints(odd.where("doc_id = 6")).first().near_next == 1.0


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(128) for _ in range(40)]
    near = set(base)
    for p in base:
        for n in (1, 2, 3, 4, 5):
            q = p
            for b in rng.sample(range(128), n):
                q ^= 1 << b
            near.add(q)

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def frame(values):
        return spark.createDataFrame([(signed(v >> 64), signed(v & (2**64 - 1))) for v in values], "high long, low long")

    found = {((r.high & (2**64 - 1)) << 64 | (r.low & (2**64 - 1)), (r.its_high & (2**64 - 1)) << 64 | (r.its_low & (2**64 - 1))) for r in fingerprints.within(frame(base), frame(near)).collect()}
    assert found == {(a, b) for a, b in product(base, near) if (a ^ b).bit_count() <= 3}


# language


def test_languages_match_plain_profiles(spark, small, table):
    got = {r.doc_id: r for r in queries.QUERIES["op7_language_id"](spark, small).collect()}
    docs = table("documents").collect()
    counts = {}
    for r in docs:
        if crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(brute.grams(r.text))
    profiles = {lang: brute.ranked(c) for lang, c in counts.items()}
    for r in docs:
        lang, score = brute.language(r.text, profiles)
        assert (got[r.doc_id].lang_pred, round(got[r.doc_id].score, 9)) == (lang, round(score, 9))
        assert got[r.doc_id].held_out == (crc32(str(r.doc_id).encode()) % 4 == 2)


def packed(text):
    return {brute._packed(g): n for g, n in brute.grams(text).items()}


def test_long_texts_are_cut_between_words(monkeypatch):
    """Over a seam as elsewhere: the n-grams of the whole text, a word longer than a piece included."""
    long = "abcdefg " * 150_000
    assert len(long) > langid.PIECE
    keys, n = langid.counted(long)
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == packed(long)
    rng = random.Random(2)
    for size in (1, 2, 3, 7, 20):
        monkeypatch.setattr(langid, "PIECE", size)
        for _ in range(40):
            text = "".join(rng.choice("abÀĞİΣ世 .1'\U00010400\n") for _ in range(rng.randrange(60)))
            keys, n = langid.counted(text)
            assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == packed(text)


def test_learning_counts_the_same_over_a_seam(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one word after another " * 60_000, "en")], "doc_id long, text string, lang string")
    got = {r.gram for r in langid.profiles(docs).collect()}
    assert got == set(packed(docs.first().text)) and crc32(b"1") % 4 != 2


def test_held_out_languages(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in queries.QUERIES["op7_language_id"](spark, sf_dir).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_languages_of_odd_rows(odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 5, 6}
    kept = langid.recognised(odd)
    assert kept.columns == odd.columns and kept.count() == 5
    assert langid.identify(none).count() == 0 and langid.recognised(none).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.where("lang is null")).collect()} == {"und"}


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header>Site {n}</header><nav><ul><li><a href="/">Menu {n}</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><h1>Head {n}</h1><p>First &amp; <b>bold</b> {n}<br>second&nbsp;line<p>third   one
here<div class="ad">Buy {n}</div><form><input value="x">Send</form><section id="comments"><p>Reader {n}</p></section>
<p style="display: none">hidden</p>a < b</article></main><aside>Side {n}</aside><footer>&copy; {n}</footer></body></html>"""


def wanted(n):
    return f"Head {n}\nFirst & bold {n}\nsecond line\nthird one here\na < b"


def test_planted_pages(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(n=i), "x") for i in range(9)] + [(20, "http://b.example/", PAGE.format(n=20), "x")]
    rows += [(30, None, None, "x"), (31, "", "", "x"), (32, "http://c.example", "just <b>text", "x"), (0, "http://a.example/0", PAGE.format(n=0), "x")]
    got = [tuple(r) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, slots string")).collect()]
    want = [(i, u, "" if not h else "just text" if i == 32 else wanted(i)) for i, u, h, _ in rows]
    assert by_id(got) == by_id([(*w, len(w[2])) for w in want])
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_gives_the_content_slot_where_no_tag_names_it(spark):
    page = "<html><body><div class=top>Top {n}</div><div class=wrap><div class=text><p>{body}</p></div></div><div class=end>End {n}</div></body></html>"
    rows = [(i, "http://h.example/", page.format(n=i, body=f"some long text of page {i} " * 9)) for i in range(6)]
    rows.append((9, "http://h.example/", "<html><body><div class=wrap><div class=text><p>no more</p></div></div></body></html>"))
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == ("some long text of page 3 " * 9).strip() and got[9] == "no more"


def test_equivalence_classes(spark):
    rows = [(i, "http://h.example/", f"<html><body><nav><ul>{'<li><a>x</a></li>' * (i % 3 + 1)}</ul></nav><article><p>t</p></article></body></html>") for i in range(6)]
    template = pages.templates(spark.createDataFrame(rows, "page_id long, url string, html string"))
    classes = {}
    for r in template.collect():
        classes.setdefault(r.class_id, []).append(r.depth)
    # li and a; html, body, nav, article, ul and p
    assert sorted(map(sorted, classes.values())) == [[1, 2, 3, 3, 4, 4], [5, 6]]


def test_pages_hold_their_documents(spark, small, table):
    known = {" ".join(t.split()) for _, t in texts(table("documents"))}
    for r in queries.QUERIES["op2_main_text"](spark, small).collect():
        assert " ".join(r.text.split("\n", 1)[1].split()) in known and r.n_chars == len(r.text)


# quality


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    field = quality.Field(rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2)))
    rows = rng.normal(size=(5, quality.WIDTH)).astype(np.float32)
    gain, total, good = rows @ field.weights, 0.0, np.zeros(5)
    for labels in product((0, 1), repeat=5):
        weight = np.exp(sum(gain[t] for t in range(5) if labels[t]) + sum(field.pairs[a, b] for a, b in zip(labels, labels[1:], strict=False)))
        total += weight
        good += weight * np.array(labels)
    assert np.allclose(field.marginals(rows), good / total)


def test_held_out_quality(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.QUERIES["op9_quality"](spark, sf_dir).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 1, 0), (7, 5, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0


# what they share


def test_row_keys_and_names(odd):
    assert common.unused(odd, "row_key", "free") == ["_row_key", "free"]
    keys = odd.select(common.row_key(odd).alias("k")).collect()
    assert len({r.k for r in keys}) == 8


#: Their rows are pairs of document and item, ranked documents, phrases or neighbours.
OTHER_ROWS = {"op5_decontaminate", "op11_lexical_search", "op12_collocations", "op13_nearest_neighbours"}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - OTHER_ROWS))
def test_queries_return_a_row_per_document_or_page(spark, small, table, name):
    source = "pages" if name in ("op2_main_text", "op8_warc_revisits") else "documents"
    assert queries.QUERIES[name](spark, small).count() == table(source).count()
