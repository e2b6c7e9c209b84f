"""Spelling variants, id files and conversation repair against brute force and libraries."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evgraph.llm import id_files, secrets, spelling, surrogates, turns
from evgraph.llm.common import new_folder, vocabulary

DOCS = "doc_id long, text string, n_chars string, word string, ids string"


# Spelling variants

def edits_one(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def plain_spelling(rows, noise):
    n = Counter()
    for id_, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.encode().lower().decode()
            h = zlib.crc32(f"{'' if id_ is None else id_}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1:] if noise and h % noise == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    out = {}
    for w in n:
        near = [v for v in n if edits_one(w, v)]
        best = min(near, key=lambda v: (-n[v], v.encode()), default=None)
        out[w] = (best if best and n[best] >= 2 * n[w] else None, n[w], len(near))
    for w, (form, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        yield w, form, root, k, m, n[form] if form else None


def spelling_rows(spark, rows, noise):
    docs = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], DOCS)
    return [tuple(r) for r in spelling.variant_groups(spelling.word_counts(docs, noise=noise)).collect()]


def test_spelling_against_brute_force(spark):
    rng = np.random.default_rng(5)
    letters = list("abcé÷")
    words = ["".join(rng.choice(letters, rng.integers(4, 9))) for _ in range(300)]
    words += ["a" * k for k in (5, 6, 7, 2_000, 2_001, 2_002)] + ["ab" * 700, "ab" * 700 + "a", "ÀÉçãû", "ÀÉçã"]
    rows = []
    for d in range(120):
        some = [words[i] for i in rng.zipf(1.3, 200) % len(words)]
        rows.append((d, " ".join(w.upper() if k % 3 else w for k, w in enumerate(some)) + ". 12-" + "_".join(some[:9])))
    rows += [(None, "  ".join(words * 2)), (3, None), (3, ""), (7, rows[7][1]), (8, " ".join(words))]
    for noise in (None, 5):
        assert sorted(spelling_rows(spark, rows, noise), key=str) == sorted(plain_spelling(rows, noise), key=str)


def test_spelling_of_nothing(spark):
    assert spelling_rows(spark, [], 97) == []
    assert spelling_rows(spark, [(1, None), (2, "word word word")], 97) == []


@given(st.lists(st.integers(0, 30), min_size=4, max_size=12, unique=True), st.randoms())
def test_pivots_are_the_cheapest_disjoint_pair(places, random):
    places.sort()
    cost = [random.randint(1, 9) for _ in places]
    best = min((ca + cb for a, ca in zip(places, cost) for b, cb in zip(places, cost) if b - a >= 2), default=None)
    if best is not None:
        a, b = spelling.pivots(places, cost)
        assert b - a >= 2 and cost[places.index(a)] + cost[places.index(b)] == best


def test_long_text_is_cut_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 10)
    raw = b"abc " * 20 + b"x" * 50 + b" y"
    assert [w for p in spelling._pieces(raw, 0, len(raw)) for w in p] == raw.split()


# Id files

@settings(max_examples=200)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=70))
def test_ranks_come_back(numbers):
    ranks = np.array(numbers, np.uint32)
    lengths = np.array([len(ranks)], np.int64) if len(ranks) else np.zeros(0, np.int64)
    got, sizes = id_files.read_block(id_files.write_block(ranks, lengths))
    assert got.tolist() == numbers and sizes.tolist() == lengths.tolist()


def test_common_ids_take_one_byte():
    control, data = id_files.pack_ranks(np.arange(256, dtype=np.uint32))
    assert len(control) == 64 and len(data) == 256
    with pytest.raises(ValueError):
        id_files.read_block(b"none" + bytes(40))


TEXTS = [
    None, "", " ", "\n", "Hello, world.", "it's  don't 'Sſ's", "áb é ́x", "İstanbul. İ.", "x.̇y .̇",
    "<|endoftext|> <|startoftext|>x", " a b\x0bc\x1cd", "한국어 한", "1234.5 ½ x² ª.º", "\U0001f600!!", "ß.Σς ΑΣ",
    "tail...", "a.b.c!d?e", "×.÷", "word" * 5_000, "\x00a", "don't.'s", "é.́", "aͅ.b",
]


def test_id_files_against_the_library(spark):
    model = Tokenizer.from_file(vocabulary(id_files.DEFAULT))
    model.encode_special_tokens = True
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, "again"), (3, "again"), (-5, " ".join(t for t in TEXTS if t))]
    docs = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], DOCS).repartition(5)
    place = new_folder(spark)
    id_files.write_ids(docs, place)
    got = sorted(id_files.read_ids(spark, place).collect(), key=lambda r: r["start"])
    want = Counter((i, tuple(model.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"])
    ids = [r["doc_id"] for r in got]
    assert ids == [None, *sorted(i for i, _ in rows if i is not None)]
    digests = {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in id_files.read_ids(spark, place, digest=True).collect()}
    assert digests == {(r["doc_id"], r["start"]): (len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in got}
    ranks = spark.read.parquet(f"{place}/ranks").orderBy("rank").collect()
    assert [r["n"] for r in ranks] == sorted((r["n"] for r in ranks), reverse=True)


def test_id_files_of_nothing_and_in_many_blocks(spark, monkeypatch):
    place = new_folder(spark)
    id_files.write_ids(spark.createDataFrame([], DOCS), place)
    assert id_files.read_ids(spark, place).collect() == []
    monkeypatch.setattr(id_files, "BLOCK_IDS", 7)
    place = new_folder(spark)
    id_files.write_ids(spark.createDataFrame([(i, "a b c " * (i % 4), "", "", "") for i in range(50)], DOCS), place)
    assert spark.read.parquet(f"{place}/blocks").count() > 10
    got = sorted(id_files.read_ids(spark, place, digest=True).collect())
    assert [r["n_tokens"] for r in got] == [3 * (i % 4) + 1 for i in range(50)]
    assert [r["start"] for r in got] == np.cumsum([0] + [3 * (i % 4) + 1 for i in range(49)]).tolist()


# Conversation repair

SPACES = "[^\x20\x09-\x0d]"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        what = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return out


def cheapest(rows):
    """Cost, audit and repaired rows of the cheapest, then least edits, by trying all."""
    seen, faults = set(), []
    for role, text in rows:
        solid = re.findall(SPACES, text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        def add(cost, letter, then, text=None):
            if then is not None:
                c, audit, kept = then
                found.append((c + cost, letter + audit, ((text,) if text is not None else ()) + kept))
        for name in ("user", "assistant"):
            if inserted < 3 and (state, name[0]) in go:
                add(5, "I", best(i, go[state, name[0]], inserted + 1), name + ":")
        if i < len(rows):
            (role, text), fault = rows[i], faults[i]
            add(2, "D", best(i + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] == "" or (state, role[:1]) in go:
                    add(more, "K", best(i + 1, state if role[:1] == "" else go[state, role[:1]], 0), f"{role}:{text}")
                for name in ("user", "assistant"):
                    if (state, name[0]) in go:
                        add(1 + more, "R", best(i + 1, go[state, name[0]], 0), f"{name}:{text}")
        return min(found, default=None)

    return best(0, "", 0), faults


def plain_repair(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for r in plain_damage(rows):
        convs[r[0]].append(r)
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        (cost, audit, kept), faults = cheapest([(r[2], r[3]) for r in own])
        known = [r[1] for r in own if r[1] is not None]
        n = Counter(faults)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        yield (conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


CONVS = "conv_id long, turn long, role string, text string, kind string, chunk string"


def conversations(rng, n, longest):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "sage", "ünder"]
    texts = ["Yes.", "No!", "cut off", "", " \t", None, " ", "Why? ", "end.\n", "again", "x" * 40 + "."]
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(1, longest))):
            for _ in range(int(rng.choice([1, 1, 1, 2]))):
                role = roles[t % 2] if rng.random() < 0.6 else roles[rng.integers(len(roles))]
                text = f"Turn {t} says {c}." if rng.random() < 0.5 else texts[rng.integers(len(texts))]
                rows.append((c if c else None, int(t * rng.choice([1, 1, 3])) if rng.random() < 0.9 else None, role, text))
    return rows


@pytest.mark.parametrize("chunk_rows", [16_384, 3])
def test_repair_against_trying_all(spark, chunk_rows):
    rng = np.random.default_rng(11)
    rows = conversations(rng, 60, 14) + [(900, None, None, None), (901, 0, "user", "Only."), (901, 0, "user", "Only.")]
    rows += [(902, t, "user", "cut") for t in range(40)]  # all but one are duplicates
    rows += [(903, t, "ua"[t % 2] + "x", f"cut {t}") for t in range(60)]  # vectors keep a difference over many chunks
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], CONVS).repartition(4)
    got = turns.repair(turns.damaged(df), chunk_rows=chunk_rows).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_repair(rows), key=str)


def test_chunks_of_bytes_and_nothing(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"{t} " + "long text " * 400 + ".") for t in range(30)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], CONVS)
    got = turns.repair(turns.damaged(df), chunk_bytes=9_000).collect()
    assert [tuple(r) for r in got] == list(plain_repair(rows))
    assert turns.repair(turns.damaged(spark.createDataFrame([], CONVS))).collect() == []


def test_fix_up_stops_where_vectors_run_along():
    rng = np.random.default_rng(2)
    for _ in range(200):
        kinds = bytes(rng.integers(0, 10, 40).tolist())
        old, new = turns.END, turns.backward(bytes(rng.integers(0, 10, 9).tolist()), turns.END)
        assert turns.fix_up(kinds, old, new, turns.backward(kinds, old)) == turns.backward(kinds, new)
    assert len(turns._BACK) < 2_000


# Long texts of the earlier operators

def plain_novel(text, taken, novelty):
    found, done = [], -1
    for word in secrets.SENSITIVE.finditer(text):
        for m in secrets.CANDIDATE.finditer(text, word.end()):
            if m.start() > word.end() + secrets.REACH:
                break
            if m.start() <= done:
                continue
            done = m.start()
            if not any(a < m.end() and m.start() < b for a, b, _ in taken) and secrets._odd(m[0]):
                added = novelty(text, m.start(), m.end())
                if added >= secrets.NOVELTY:
                    found.append((m.start(), m.end(), "novel", added))
    return found


def test_bounded_search_finds_the_same_secrets():
    rng = np.random.default_rng(3)
    novelty = secrets.Novelty()
    parts = ["token", " secret=", "private key ", "aB3", "Zq9xK2mW7vLp4RtY", " ", "\n", "prose of words ", "deadbeef" * 4, "AKIA" + "B" * 18, "x" * 70, "=."]
    n = 0
    for _ in range(700):
        text = "".join(rng.choice(parts, 30))
        base = secrets.base_spans(text)
        want = plain_novel(text, base, novelty)
        assert secrets.novel_spans(text, base, novelty) == want
        n += len(want)
    assert n > 100


def test_secrets_of_a_long_text_take_seconds():
    start = time.perf_counter()
    secrets.scan("token of " * 550_000, secrets.Novelty())
    secrets.scan("token=abcdef1 " * 100_000, secrets.Novelty())
    assert time.perf_counter() - start < 120


def test_personal_data_of_an_unbroken_text_take_seconds(spark):
    start = time.perf_counter()
    docs = spark.createDataFrame([(1, "a1" * 2_500_000), (2, "Mr. John_x@y.com and .abc@mail.org")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in surrogates.replace_personal_data(docs.withColumn("n_chars", docs.doc_id), "key").collect()}
    assert got[1] == "a1" * 2_500_000
    assert "y.com" not in got[2] and "abc@mail" not in got[2] and "John" not in got[2]
    assert time.perf_counter() - start < 120
