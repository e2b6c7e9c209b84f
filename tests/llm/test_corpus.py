"""Operators over whole tables against brute-force versions, and the pipeline."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evgraph.llm import collision_search, jaccard, packing, surrogates, url_rules
from evgraph.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_components(docs, width, percent):
    sets = {i: shingles(t, width) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, words, n, changes):
    base = [rng.choice(words) for _ in range(n)]
    out = []
    for _ in range(changes):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(n)] = rng.choice(words)
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def similar():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "  \t", "one", "ONE", "one two", "one two three four", "a b c d e", "a b c d e", "ı İ é", "x " * 4000]
    for n, changes in ((120, 30), (60, 12), (200, 8), (30, 6)):
        texts += family(rng, words, n, changes)
    texts += [" ".join(rng.choice(words) for _ in range(80)) for _ in range(30)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(60)) for _ in range(15)]
    return list(enumerate(texts))


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_jaccard_components(spark, similar, width, percent):
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in similar], "doc_id long, text string, block long, sig string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(docs, width, percent).collect()}
    assert got == brute_components(similar, width, percent)


def test_jaccard_without_rounds_of_pivots(spark, similar):
    docs = spark.createDataFrame(similar, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(docs, 4, 85, rounds=0).collect()}
    assert got == brute_components(similar, 4, 85)


def test_jaccard_edges(spark):
    docs = spark.createDataFrame([(7, "same words here now"), (3, "same words here now"), (3, "same words here now"), (None, "same words here now")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.similar_components(docs).collect()} == {(7, 3), (3, 3), (None, 3)}
    assert jaccard.keep_first(docs).count() == 2
    assert jaccard.similar_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [jaccard.LINK_NODES, 7])
def test_jaccard_links(spark, similar, monkeypatch, block):
    monkeypatch.setattr(jaccard, "LINK_NODES", block)
    data = [*similar, *((1000 + i, similar[i][1]) for i in range(8, 40, 3)), (None, similar[20][1])]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    sets = [shingles(t, 4) for _, t in data]
    want = [
        (i, sum(k != j and bool(y) and 100 * len(x & y) >= 85 * len(x | y) for j, y in enumerate(sets)))
        for k, ((i, _), x) in enumerate(zip(data, sets))
    ]
    got = [(r.doc_id, r.n_links) for r in jaccard.similar_components(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and max(n for _, n in want) >= 20


def test_keep_first_decides_by_row(spark):
    near = [" ".join(f"w{i}" for i in range(60)) + f" {x}" for x in ("a", "b", "c")]
    lone = [" ".join(f"{x}{i}" for i in range(60)) for x in "xyz"]
    data = [(1, near[0]), (5, near[1]), (5, lone[0]), (None, near[2]), (None, near[2]), (None, lone[1]), (7, lone[2]), (7, lone[2].upper())]
    data += [(None, None), (None, None), (8, ""), (8, "")]
    got = [tuple(r) for r in jaccard.keep_first(spark.createDataFrame(data, "doc_id long, text string")).collect()]
    sevens = [r for r in got if r[0] == 7]
    assert len(sevens) == 1 and sevens[0] in data
    want = [(1, near[0]), (5, lone[0]), (None, near[2]), (None, near[2]), (None, lone[1]), (None, None), (None, None), (8, "")]
    assert sorted((r for r in got if r[0] != 7), key=str) == sorted(want, key=str)


def test_shingle_sets_are_exact():
    import pyarrow as pa

    texts = ["A b\tc\x0bd  e", "a b c d e", "", "x", "\x1ca b", "b c d", "a b c d e f"]
    sets = [set(s.tolist()) for s in jaccard.shingle_sets(pa.array(texts))]
    want = [shingles(t, 4) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(sets[i]) == len(want[i]) and len(sets[i] & sets[j]) == len(want[i] & want[j])


def vectors(spark, data):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id long, embedding array<float>, h long, q int")


def brute_nearest(data, k):
    good = {}
    for i, v in data:
        if v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0):
            good[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in good:
        if q % 20 == 0:
            near = sorted((-float(v @ good[q]), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_collision_search(spark, monkeypatch):
    monkeypatch.setattr(collision_search, "VECTOR_BLOCK", 300)
    monkeypatch.setattr(collision_search, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 24))
    data = [(i, (centres[i % 12] + 0.4 * rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(900)]
    data += [(1000 + i, data[40][1]) for i in range(60)]  # a group of copies
    data += [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [1.0, None]), (2080, [1.0, 2.0]), (2081, [3.0, 1.0]), (2100, [])]
    want = brute_nearest(data, 20)
    got = {}
    for r in collision_search.nearest(vectors(spark, data), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(len(v) for v in want.values())
    assert [i for i, _ in got[1000]] == [i for i, _ in want[1000]]  # ties go to the smaller id
    assert got[2080] == [(2081, 5.0)]
    plain = dict(data)
    for q, near in got.items():
        for i, s in near:
            assert s == pytest.approx(float(np.dot(np.array(plain[i], float), np.array(plain[q], float))), abs=1e-9)
    assert collision_search.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_texts_are_searched_for_personal_data_once(spark, monkeypatch):
    """What the surrogates are put into comes from rows that were written with their matches; a column without a type stays."""
    written = []
    real = surrogates.stored
    monkeypatch.setattr(surrogates, "stored", lambda d: written.append(d.columns) or real(d))
    docs = spark.createDataFrame([(1, "write to anna.smith@mail.org", "x"), (2, "nothing here", None)], "doc_id long, text string, old string").withColumn("none", F.lit(None))
    got = surrogates.replace_personal_data(docs, "k")
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString() and written == [["row", "found"]]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[1]["n_entities"] == 1 and "anna" not in rows[1]["text"] and rows[1]["old"] == "x" and rows[1]["none"] is None
    assert rows[2]["text"] == "nothing here" and got.columns == ["doc_id", "text", "old", "none", "n_entities"]


def test_blocks_are_sent_once_for_many_queries_and_windows_count_as_defined():
    """Groups of queries are few where blocks are many; a search equals one that counts windows by their definition."""
    assert collision_search.query_groups(600_000, 30_000, 24) == 4
    assert collision_search.query_groups(51_300, 2_565, 24) == 3
    rng = np.random.default_rng(3)
    vectors, queries, k = rng.normal(size=(300, 12)), rng.normal(size=(25, 12)), 5
    top = float(np.sqrt((vectors**2).sum(1)).max())
    block = collision_search.Block(vectors, top)
    rest = np.sqrt(np.maximum(0.0, top**2 - (vectors**2).sum(1)))
    lines = vectors @ block.axes[:-1] + rest[:, None] * block.axes[-1]
    for query, (found, scores) in zip(queries, block.search(queries, k)):
        norm, radius = np.sqrt((query**2).sum()), collision_search.FIRST_RADIUS * top
        spot = query * top / norm @ block.axes[:-1]
        while True:
            near = np.flatnonzero((np.abs(lines - spot) <= collision_search.HALF_WINDOW * radius).sum(1) >= collision_search.SHARE * 40)
            best = sorted(vectors[near] @ query)[::-1][:k]
            if len(near) >= k and (np.sqrt(max(0.0, 2 * top**2 - 2 * top * best[-1] / norm)) <= radius or len(near) == 300):
                break
            radius *= collision_search.GROWTH
        assert len(found) == k and np.allclose(sorted(scores)[::-1], best)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_recall_on_the_given_vectors(spark):
    pdf = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    data = [(int(i), list(v)) for i, v in zip(pdf.vec_id, pdf.embedding)]
    want = brute_nearest(data, 20)
    got = {}
    for r in QUERIES["op2_collision_search"](spark, FOLDER).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(len(v) for v in want.values())


MAIL = "und.34@mail7.example.com"
PRIVATE = [
    f"write to {MAIL}, or call +1 (564) 555-4526 at 84.93.123.184.", f"{MAIL.upper()} paid with 4432507379035540",
    "Mr. John Smith and Mrs Anna Smith, later Mr. Smith. Frau Müller", "Господин Иван Петров", "IBAN DE89 3704 0044 0532 0130 00, 078-05-1120",
    "card 4432-5073-7903-5540 or (564) 555-4526", "version 1.2.3, token 2321bac4d15ec8f90433955bf9d3cf61da5bdd1e", None, "", "plain prose",
]


def private(spark, texts):
    return spark.createDataFrame(
        [(i, t, len(t or ""), "f", [1], 5) for i, t in enumerate(texts)],
        "doc_id long, text string, n_chars long, found string, row array<int>, n_entities int")


def test_surrogates(spark):
    docs = private(spark, PRIVATE)
    out = surrogates.replace_personal_data(docs, "key")
    got = {r.doc_id: r for r in out.collect()}
    assert set(out.columns) == set(docs.columns)
    for i, t in enumerate(PRIVATE):
        assert (got[i].text is None) == (t is None) and got[i].n_chars == len(got[i].text or "")
        for secret in (MAIL, MAIL.upper(), "5644526", "84.93.123.184", "4432507379035540", "4432-5073", "Smith", "Anna", "John", "Петров", "078-05-1120", "3704"):
            assert secret not in (got[i].text or "")
    assert [got[i].n_entities for i in range(10)] == [3, 2, 4, 1, 2, 2, 0, 0, 0, 0]
    assert [got[i].text for i in (6, 7, 8, 9)] == PRIVATE[6:]
    address = re.search(r"to (\S+@\S+),", got[0].text)[1]
    assert got[1].text.startswith(address.upper()) and re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.example\.com", address)
    phone = re.search(r"call \+1 (\(\d{3}\) \d{3}-\d{4})", got[0].text)[1]
    assert got[5].text.endswith(phone)  # one number in two forms
    card = re.search(r"paid with (\d{16})$", got[1].text, re.I)[1]
    assert re.search(r"card ([\d-]+)", got[5].text)[1].replace("-", "") == card
    a, b, c, _ = re.fullmatch(r"Mr\. (\S+) (\S+) and Mrs (\S+) \2, later Mr\. \2\. Frau (\S+)", got[2].text).groups()
    latin = surrogates.GIVEN["latin"]
    assert a in latin["m"] and c in latin["f"] and b[0].isupper()
    assert re.fullmatch(r"Господин [А-Я][а-я]+ [А-Я][а-я]+", got[3].text)
    again = {r.doc_id: r.text for r in surrogates.replace_personal_data(docs, "key").collect()}
    other = {r.doc_id: r.text for r in surrogates.replace_personal_data(docs, "other").collect()}
    assert again == {i: r.text for i, r in got.items()} and other[0] != got[0].text
    assert surrogates.replace_personal_data(docs.limit(0), "key").count() == 0


def luhn(s):
    return sum(d - 9 if d > 9 else d for i, c in enumerate(reversed(s)) for d in [int(c) * (1 + i % 2)]) % 10


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_numbers_stay_valid_by_type(spark):
    cards = ["4111 1111 1111 1111", "378282246310005", "5500-0000-0000-0004", "6011000990139424"]
    ibans = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "NL91ABNA0417164300"]
    phones = ["+49 30 1234 5678", "+33 30 1234 5678", "+491512345678", "+1 212 555 0123", "(212) 555-0123", "+380 44 123 4567"]
    out = [r.text[2:-2] for r in surrogates.replace_personal_data(private(spark, [f"x {v} y" for v in cards + ibans + phones]), "key").orderBy("doc_id").collect()]
    for old, new in zip(cards + ibans + phones, out):
        assert old != new and re.sub(r"\d", "0", old)[-3:] == re.sub(r"\d", "0", new)[-3:] and len(old) == len(new)
    assert all(luhn(re.sub(r"\D", "", c)) == 0 for c in cards + out[:4])
    assert all(mod97(c.replace(" ", "")) == 1 for c in ibans + out[4:7])
    assert [o[:2] for o in out[4:7]] == ["DE", "GB", "NL"]
    german, french, mobile, us, plain, ukraine = out[7:]
    assert german.startswith("+49 ") and french.startswith("+33 ") and german[4:] != french[4:] and ukraine.startswith("+380 ")
    assert mobile.startswith("+49") and not mobile.startswith("+491512")
    assert re.sub(r"\D", "", us) == "1" + re.sub(r"\D", "", plain)  # one number with and without its code


def test_collisions_are_drawn_again(spark):
    names = [a + b for a in "bcdfg" for b in "aeiouyhk"]
    docs = private(spark, [f"Mr. {n.title()} Oak" for n in names] + ["Mr. Adam Oak"] + [f"Mr. {names[0].title()} Oak"])
    out = {r.doc_id: r.text for r in surrogates.replace_personal_data(docs, "key").collect()}
    given = [out[i].split()[1] for i in range(41)]
    assert len(set(given)) == 41 and out[41] == out[0]  # more names than the list has, all different
    assert "Adam" not in given and len({t.split()[2] for t in out.values()}) == 1
    plan = surrogates.replace_personal_data(docs, "key")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def page(url, head=""):
    return url, f"<html><head>{head}</head><body>x</body></html>"


def test_url_rules_and_redirects(spark):
    data = [
        page("http://A.Example.NET/en/1"), page("https://x.net/q?a=://y"), page("http://notnet/"), page("http://www.example.com/de/x#f"),
        page("http://www.example.com/d"), page("http://s.org/fr/1", '<link rel="canonical" href="http://bad.net/p">'), page(None), page("no scheme"),
        page("http://s.org/a", "<link href='http://bad.net/p' rel=canonical>"), page("http://t.org/b", '<meta http-equiv="refresh" content="0; url=http://s.org/a">'),
        page("http://u.org/c", '<link rel="canonical" href="/d">'), page("http://u.org/d"), page("http://t.org/b"), page("http://v.org/"),
    ]
    docs = spark.createDataFrame([(i, u, h, "r", 1) for i, (u, h) in enumerate(data)], "page_id long, url string, html string, rule string, host int")
    links = spark.createDataFrame([("http://v.org/", "http://u.org/d"), ("http://u.org/c", "http://z.net/")], "a string, b string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(docs).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("x.net", "/q", "net/", "block") and got[2] == ("notnet", "/", None, "allow")
    assert got[3][2:] == ("example.com/de/", "block") and got[4] == ("www.example.com", "/d", None, "allow")
    assert got[5][2:] == ("org/fr/", "allow") and got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8][3] == got[9][3] == got[12][3] == "block" and got[10][3] == got[11][3] == got[13][3] == "allow"
    more = {r.page_id: r.verdict for r in url_rules.judge(docs, links).collect()}
    assert [more[i] for i in (10, 11, 13, 5)] == ["block", "block", "block", "allow"]
    assert url_rules.judge(docs.limit(0)).count() == 0


def test_url_sql_with_links(spark, folder):
    import duckdb

    rows = [(i, *page(u, h)) for i, (u, h) in enumerate([
        ("http://s.org/a", '<link rel="canonical" href="http://bad.net/p">'), ("http://t.org/b", '<meta http-equiv="refresh" content="0; url=http://s.org/a">'),
        ("http://u.org/fr/x", '<link rel="canonical" href="http://s.org/a">'), ("http://w.org/", ""), (None, "")])]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = con.execute(SQL["op10_url_filters"]).df().sort_values("page_id").astype(str).values.tolist()
    got = QUERIES["op10_url_filters"](spark, folder).orderBy("page_id").toPandas().astype(str).values.tolist()
    assert [[*r[:4], r[4]] for r in got] == want and [r[4] for r in got] == ["block", "block", "allow", "allow", "allow"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    data = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "jaccard_join", "surrogates", "packing"]
    known = stages["language_id"](spark, docs, FOLDER)
    assert known.columns == docs.columns and known.count() >= 0.99 * docs.count()
    apart = stages["jaccard_join"](spark, known, FOLDER)
    comps = brute_components([(r.doc_id, r.text) for r in known.collect()], 5, 80)
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i, (_, c) in comps.items() if i == c)
    hidden = stages["surrogates"](spark, apart, FOLDER)
    assert hidden.columns == docs.columns
    changed = 0
    for r in hidden.collect():
        old = data[r.doc_id].text
        for m in re.findall(r"[\w.+-]+@[\w.-]+\w|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w])|(?<!\w)\d{16}(?!\w)", old):
            changed += 1
            assert m not in r.text
        if r.text == old:
            assert r.n_chars == data[r.doc_id].n_chars
    assert changed
    out = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert set(out["doc_id"]) == {r.doc_id for r in apart.collect()}
    assert out.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY
    assert out["sequence_id"].nunique() <= 1.01 * out["length"].sum() / packing.CAPACITY + 1
