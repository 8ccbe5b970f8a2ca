"""Token counts, collocations and vector codes against the library and brute force; nulls, ties, long rows, empty tables."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

SIGNS = ["a", "b", "the", "'s", "'re", "'", "'l", "ll", " ", "  ", "\n", "\n\n", "\t", "é", "日本", "1", "23", "!", "...", "<|endoftext|>", "<|endo", " ", "\x1c", "ing", " w", "​", "😀", "\x85", "ĉ"]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    from sitelake.llm.tokencount import default_model

    tokenizer = tokenizers.Tokenizer.from_file(default_model())
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    from sitelake.llm import tokencount as tc

    with open(tc.default_model(), "rb") as f:
        return tc.Counter(f.read())


# --- token counts


def test_counts_of_all_prefixes_equal_the_library(counter, library):
    r = random.Random(5)
    for _ in range(400):
        text = "".join(r.choice(SIGNS) for _ in range(r.randint(0, 14)))
        got = np.cumsum(np.concatenate([*counter.blocks(text)])).tolist()
        assert got == [library(text[:i]) for i in range(1, len(text) + 1)], text


def test_pairs_by_their_rims_equal_merging(counter):
    r = random.Random(6)
    for _ in range(5000):
        a, b = r.choice(counter.tokens), r.choice(counter.tokens)
        assert counter.separate(a, b) == (counter.merged(a + b) == [a, b]), (a, b)


def test_long_words_and_texts_of_many_blocks(counter, library, monkeypatch):
    from sitelake.llm import tokencount as tc

    monkeypatch.setattr(tc, "BATCH", 1000)
    monkeypatch.setattr(tc, "BLOCK", 64)
    r = random.Random(7)
    word = "".join(r.choice("abcdeénop") for _ in range(5000))
    for text in (word, word + " " * 700 + "x", "a b " * 900 + "<|endoftext|>" + "\n" * 300, "é" * 3000):
        blocks = [*counter.blocks(text)]
        assert all(len(b) == 64 for b in blocks[:-1]) and 0 < len(blocks[-1]) <= 64
        counts = np.cumsum(np.concatenate(blocks))
        assert len(counts) == len(text) and counts[-1] == library(text)
        for i in r.sample(range(1, len(text)), 25):
            assert counts[i - 1] == library(text[:i]), i


def test_questions_are_answered_from_the_table(spark, library, monkeypatch):
    from sitelake.llm import tokencount as tc
    from sitelake.llm.common import written

    long = "Thorough words, don't they'll 12345 naïve\n\n  end. " * 700
    rows = [(1, "One text, it's short.", "x"), (1, "One text, it's short.", "y"), (None, None, "z"), (4, "", "z"), (5, long, "z"), (6, " \n x<|endoftext|>y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    table = written(tc.prefix_counts(docs), "prefix-counts")
    whole = {(r.doc_id, r.n_tokens, r.n_bytes) for r in table.filter("last").collect()}
    assert whole == {(i, library(t or ""), len((t or "").encode())) for i, t, _ in rows}
    assert table.filter("last").select("row").distinct().count() == len(rows)
    got = {r.doc_id: r.over_limit for r in tc.over_budget(table, 512).collect()}
    assert got == {1: False, None: False, 4: False, 5: True, 6: False}
    text_of = {r.row: (r.doc_id, next(t or "" for i, t, _ in rows if i == r.doc_id)) for r in table.filter("last").collect()}
    asked = [(row, n) for row, (_, t) in text_of.items() for n in (-1, 0, 1, 7, tc.BLOCK, tc.BLOCK + 1, len(t), len(t) + 5)]
    answers = tc.tokens_at(table, spark.createDataFrame(asked, "row long, n_chars long")).collect()
    assert len(answers) == len(asked)
    for a in answers:
        assert a.n_tokens == library(text_of[a.row][1][: max(0, a.n_chars)]), a
    for budget in (0, 3, 512):
        for r in tc.longest_prefixes(table, budget).collect():
            text = text_of[r.row][1]
            near = range(max(0, r.n_chars - 5), min(len(text), r.n_chars + 40) + 1)
            assert r.n_chars == max((i for i in near if library(text[:i]) <= budget), default=0)
            assert r.n_tokens == library(text[: r.n_chars])
    cut = tc.truncated(docs, 3)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert {(r.doc_id, r["a.b"]): r.text for r in cut.collect()}[(1, "y")] == "One text,"
    assert tc.count_digest(docs.filter("false")).isEmpty()


def test_other_models_are_refused():
    from sitelake.llm.tokencount import refusal

    plain = {"model": {"type": "BPE"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}
    assert refusal(plain) is None
    assert refusal(plain | {"model": {"type": "WordPiece"}}) and refusal(plain | {"normalizer": {"type": "NFC"}})
    assert refusal(plain | {"pre_tokenizer": {"type": "Whitespace"}}) and refusal(plain | {"added_tokens": [{"content": "x", "lstrip": True}]})


# --- collocations


def brute_collocations(rows, least, share, most):
    import re

    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n\v\f\r]", low):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, 5) for i in range(len(ws) - k + 1))
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        score, j = min((2000000 * a // (f[lang, p[:j]] + f[lang, p[j:]]), j) for j in range(1, len(p)))
        inside = any(len(q) > len(p) and g == lang and b >= least and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in f.items())
        if not inside:
            out.append((lang, " ".join(p), a, f[lang, p[:j]], f[lang, p[j:]], n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranks = Counter()
    return [(x[0], ranks[x[0]], *x[1:]) for x in out if not ranks.update([x[0]]) and ranks[x[0]] <= most]


def test_collocations_equal_counting_everything(spark, monkeypatch):
    from sitelake.llm import collocations as cl

    r = random.Random(8)
    words = ["In", "in", "spite", "of", "the", "é", "ß", "x1", "many", "things", " ", "-"]
    ends = [".", ", ", "\n", "\r\n", "; ", "!?", " ", "\t", "  ", "\v"]
    texts = ["".join(r.choice(words) + (r.choice(ends) if r.random() < 0.15 else " ") for _ in range(r.randint(0, 80))) for _ in range(150)]
    rows = [(t, r.choice(["en", "en", "de", None])) for t in texts]
    rows += [("in spite of the many things " * 40, "en"), (None, "en"), ("", None), ("dup dup dup dup dup dup dup. " * 30, "und")] + [rows[0]] * 7
    docs = spark.createDataFrame([(i, t, g, "n") for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, chunk string")
    for most in (2000, 5):
        got = sorted(tuple(x) for x in cl.collocations(docs, 12, 80, most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        assert got == sorted(brute_collocations(rows, 12, 80, most)) and got
    assert cl.collocations(docs.filter("false")).isEmpty()


def test_chunks_overlap_and_say_each_place_once():
    from sitelake.llm import collocations as cl

    r = random.Random(9)
    texts = [[r.choice([b"a", b"b", b"c", b"d", b"e", b"\xff"]) for _ in range(r.randint(1, 300))] for _ in range(40)] + [[b"same"] * 3000]
    flat, ends = [], []
    for t in texts:
        flat += t
        ends.append(len(flat))
    batch = cl._parsed(flat, ends, ["en"] * len(ends)).to_pylist()
    seen = Counter()
    for row in batch:
        ws = row["chunk"].split(" ")
        for i in range(len(ws) - (cl.OVERLAP if row["closed"] else 0)):
            seen[tuple(ws[i : i + 4])] += row["n"]
    plain = lambda t: tuple(w.decode() if w != b"\xff" else "\n" for w in t)
    want = Counter(plain(t[i : i + 4]) for t in texts for i in range(len(t)))
    assert sum(x["words"] * x["n"] for x in batch) == sum(w != b"\xff" for t in texts for w in t)
    assert seen == want


def test_hashes_and_numbers_of_phrases(monkeypatch):
    """Hashes are those of a word's bytes, wherever it stands; phrases are told apart however many words fit one number."""
    import pyarrow as pa

    from sitelake.llm import collocations as cl

    words = ["", "a", "b", "ab", "ba", "é", "x" * 5000, "\0", "\0\0", "a"]
    own = cl.hashed(pa.array(words))
    assert len(set(own.tolist())) == len(set(words)) and own[1] == own[9]
    assert (cl.hashed(pa.array([w.encode() for w in words]).slice(3, 5)) == own[3:8]).all() and len(cl.hashed(pa.array([], pa.binary()))) == 0
    rng = np.random.default_rng(8)
    chunks = [" ".join(rng.choice(["a", "b", "cc", "\n"], 12)) for _ in range(300)]
    langs = rng.choice(["en", "de"], 300).tolist()
    flat = cl._Flat(pa.table({"lang": langs, "chunk": chunks, "closed": [False] * 300, "n": [1] * 300}).to_batches()[0])
    symbols = [(x, w) for x, c in zip(langs, chunks, strict=True) for w in c.split(" ")]
    assert (flat.hash() == cl.mixed(cl.hashed(pa.array([x for x, _ in symbols])), cl.hashed(pa.array([w for _, w in symbols])))).all()
    for k in (1, 2, 3, 4):
        places = np.flatnonzero(flat.left >= k)
        for keys in (flat.key, np.arange(1 << 22)):  # the longer range doesn't fit three times
            monkeypatch.setattr(flat, "key", keys)
            one, which = flat.distinct(places, k)
            phrase = lambda p, k=k: tuple(symbols[p : p + k])
            assert [phrase(one[w]) for w in which] == [phrase(p) for p in places.tolist()] and len({phrase(p) for p in one.tolist()}) == len(one)
        monkeypatch.undo()


def test_far_boundaries_are_cut(monkeypatch):
    from sitelake.llm import collocations as cl

    monkeypatch.setattr(cl, "TRIGGER", 1 << 31)
    monkeypatch.setattr(cl, "MOST", 50)
    batch = cl._parsed([x.encode() for x in "abcdefgh" * 60], [480], ["en"]).to_pylist()
    assert max(len(x["chunk"].split(" ")) for x in batch) <= 50 + cl.OVERLAP
    assert sum((len(x["chunk"].split(" ")) - (cl.OVERLAP if x["closed"] else 0)) * x["n"] for x in batch) == 480


def test_shared_bits_change_nothing(spark, monkeypatch):
    from sitelake.llm import collocations as cl

    docs = spark.createDataFrame([("a b c d e f g " * 20 + f"h{i} i{i}. a b c", "en") for i in range(20)], "text string, lang string")
    want = sorted(map(tuple, cl.collocations(docs, 15).collect()))
    monkeypatch.setattr(cl, "marks", lambda found: np.full(cl.FILTER_BITS // 8, 255, np.uint8))
    assert sorted(map(tuple, cl.collocations(docs, 15).collect())) == want


# --- vector codes


def brute_codes(rows, entries=256, rounds=4):
    rows = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in rows) // 4)
    whole = [[math.floor(x * 1024) if abs(x) < 1e300 else int(x) * 1024 for x in v] + [0] * (4 * width - len(v)) for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))
    books = [[whole[k][p * width : (p + 1) * width] for k in order[:entries]] for p in range(4)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((dist(w[p * width : (p + 1) * width], e), j) for j, e in enumerate(books[p])) for p in range(4)] for w in whole]

    for _ in range(rounds):
        near = assign()
        for p in range(4):
            for j in range(len(books[p])):
                own = [w[p * width : (p + 1) * width] for w, n in zip(whole, near, strict=True) if n[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    near = assign()
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in n) for n in near]
    fit = lambda x: x if x is not None and x < 2**63 else None
    by_label = {label: [fit(e) for (_, _, g), e in zip(rows, errors, strict=True) if g == label] for _, _, label in rows}
    total = {g: None if None in es else fit(sum(es)) for g, es in by_label.items()}
    return sorted(((i, "".join(f"{j:02x}" for _, j in n), fit(e), total[label], digest) for (i, _, label), n, e in zip(rows, near, errors, strict=True)), key=str)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, far string")


def test_codes_equal_brute_force(spark):
    from sitelake.llm import vectorcodes as vc

    r = random.Random(10)
    point = lambda: [float(np.float32(r.gauss(0, 0.3))) for _ in range(12)]
    rows = [(i, point(), r.choice([1, 1, 2, None])) for i in range(420)]
    same = point()
    rows += [(500 + i, same, 3) for i in range(60)] + [(7, point(), 1), (7, point(), 1), (None, point(), 1)]
    rows += [(600, None, 1), (601, [1.0, None] * 6, 1), (602, [float("nan")] * 12, 1), (603, [float("-inf")] * 12, 1), (604, [0.5] * 5, 2), (605, [], 2)]
    out = vc.code_digest(vectors(spark, rows).repartition(5))
    assert sorted((tuple(x) for x in out.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str) == brute_codes(rows)
    few = rows[:9]
    assert sorted((tuple(x) for x in vc.code_digest(vectors(spark, few)).collect()), key=str) == brute_codes(few)
    assert vc.code_digest(vectors(spark, rows).filter("false")).isEmpty()
    assert vc.code_digest(vectors(spark, [(1, None, 1)])).isEmpty()


def test_large_numbers_are_exact(spark):
    from sitelake.llm import vectorcodes as vc

    r = random.Random(11)
    rows = [(i, [r.uniform(-1, 1) * 10.0 ** r.choice([0, 5, 9, 20, 307]) for _ in range(4)], 1) for i in range(290)]
    got = vc.code_digest(vectors(spark, rows, "double"))
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_codes(rows)


def test_pivots_prune_and_lose_nothing():
    from sitelake.llm import vectorcodes as vc

    r = np.random.default_rng(12)
    centres = r.normal(0, 3000, (8, 16))
    book = np.rint(centres[r.integers(0, 8, 256)] + r.normal(0, 30, (256, 16))).astype(np.int64)
    book[9] = book[4]
    parts = np.rint(centres[r.integers(0, 8, 500)] + r.normal(0, 30, (500, 16))).astype(np.int64)
    pivots = vc.pivots_of(book)
    own, between = vc.root(vc.squared(parts[:, None], pivots[None])), vc.root(vc.squared(pivots[:, None], book[None]))
    index, best, n = vc.nearest(parts, own, book, between)
    d = ((parts[:, None] - book[None]) ** 2).sum(-1)
    assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
    assert n.mean() < 100  # of 256
    digits = [[-(1 << 200), 5, -1, (1 << 62), -(1 << 62), 0][i] for i in range(6)]
    assert [sum(d << vc.DIGIT * k for k, d in enumerate(vc.in_digits(v))) for v in digits] == digits
