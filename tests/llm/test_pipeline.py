"""run() and its stages against a brute-force version in plain Python."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

SPACE = " \t\n\v\f\r"
DATA = "/root/testdata/sf0.001"


def passage(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def tokens(s):
    """Words between ASCII white space."""
    for c in SPACE[1:]:
        s = s.replace(c, " ")
    return [w for w in s.split(" ") if w]


def brute_quality(rows):
    """rows: (doc_id, text, source)."""
    lines_of = lambda t: [(line, " ".join(tokens(low(line)))) for line in t.split("\n")]
    holders, hosts = defaultdict(set), defaultdict(set)
    for i, t, s in rows:
        hosts[s].add(i)
        for _, k in lines_of(t):
            if k:
                holders[s, k].add(i)
    out = []
    for i, t, s in rows:
        w = tokens(t)
        triples = list(zip(w, w[1:], w[2:], strict=False))
        n = Counter(triples)
        repeated = {j + k for j, x in enumerate(triples) if n[x] > 1 for k in range(3)}
        gone = [bool(k) and len(h := holders[s, k]) >= max(10, 0.005 * len(hosts[s])) and i != min(h) for _, k in lines_of(t)]
        lost = sum(len(k.split(" ")) for (_, k), g in zip(lines_of(t), gone, strict=True) if g)
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and lost < 0.5 * len(w):
            out.append((i, "\n".join(line for (line, _), g in zip(lines_of(t), gone, strict=True) if not g), s))
    return out


def brute_lines(rows):
    key = lambda line: low(line.strip(SPACE))
    holders = defaultdict(set)
    for i, t, _ in rows:
        for line in t.split("\n"):
            holders[key(line)].add(i)
    drop = lambda i, k: len(k) >= 10 and len(holders[k]) > 1 and i != min(holders[k])
    return [(i, "\n".join(line for line in t.split("\n") if not drop(i, key(line))), s) for i, t, s in rows]


def brute_near(rows):
    from sitelake.llm.simhash import fingerprint

    fps = {t: fingerprint(t) for _, t, _ in rows}
    root = {f: f for f in fps.values()}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    kinds = sorted(root)
    for a in kinds:
        for b in kinds:
            if a < b and (a ^ b).bit_count() <= 3:
                root[top(a)] = top(b)
    groups = defaultdict(list)
    for i, t, s in rows:
        groups[top(fps[t])].append((i, hashlib.md5(t.encode()).digest(), t, s))
    return [(i, t, s) for i, _, t, s in (min(g) for g in groups.values())]


def brute_clean(rows, items):
    from sitelake.llm import decontam

    windows = defaultdict(set)
    for _, t in items:
        w = decontam.words((t or "").encode())
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[len(w[i : i + 13])].add(tuple(w[i : i + 13]))
    out = []
    for i, t, s in rows:
        w = decontam.words(t.encode())
        hit = {k for n, own in windows.items() for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in own for k in range(j, j + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append((i, t, s))
    return out


def brute(rows, items):
    """The rows after each of the first four stages."""
    rows = [(i, t or "", s or "") for i, t, s in rows]
    out = []
    for stage in (brute_quality, brute_lines, brute_near, lambda r: brute_clean(r, items)):
        out.append(rows := stage(rows))
    return out


def tables(spark, d, rows, items):
    spark.createDataFrame([(i, t, "en", s, len(t or ""), 0, "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, `_own_id` int, row string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")


def made():
    """Copies, near copies, shared and frequent lines, benchmark passages, short, null and repetitive texts."""
    r = random.Random(11)
    items = [(k, passage(40, k)) for k in range(3)] + [(7, "two words"), (8, None)]
    texts = [passage(80, 10 + i) for i in range(30)]
    texts += [texts[0], texts[1], texts[2] + " more", texts[3].replace(" ", "\n", 3)]
    texts += [f"{passage(60, 40 + i)}\nthis line stands in several documents\n{passage(60, 90 + i)}" for i in range(4)]
    texts += [f"{passage(45, 60 + i)}\n{passage(30, 600)}\n{passage(35, 120 + i)}" for i in range(14)]
    texts += [f"{passage(30, 601)}\n{passage(30, 602)}\n{passage(9, 160 + i)}" for i in range(12)]
    texts += [f"{passage(70, 200)} {items[0][1]} {passage(30, 201)}", f"{passage(900, 202)} {items[1][1][:90]}", f"{passage(60, 203)} two WORDS {passage(40, 204)}", f"{passage(20, 205)} two-words {passage(15, 206)} {items[2][1]}"]
    texts += ["too short", None, "", "x y z " * 100, " ".join(texts[:40])]
    return [(i, t, r.choice(["s", "s", "t", None])) for i, t in enumerate(texts)], items


def test_run_equals_brute_force(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline
    from sitelake.llm import pieces
    from sitelake.llm.queries import table

    rows, items = made()
    rows = [(i, t, "s" if 38 <= i < 64 else s) for i, t, s in rows]  # frequent lines in one source
    d = str(tmp_path)
    tables(spark, d, rows, items)
    want = brute(rows, items)
    docs = table(spark, d, "documents")
    columns = docs.columns
    for (name, stage), own in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = stage(spark, docs, d)
        assert docs.columns == columns, name
        assert sorted((x.doc_id, x.text or "", x.source or "") for x in docs.collect()) == sorted(own), name
        assert all(x.n_chars == len(x.text) for x in docs.collect()), name
    assert len(rows) > len(want[0]) > len(want[2]) > len(want[3]), "every filtering stage has something to do"
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, d).collect()}
    assert {i: list(x.ids) for i, x in got.items()} == {i: sp.encode(t) for i, t, _ in want[3]}
    assert all(x.round_trip and x.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t, _ in want[3] for x in [got[i]])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_run_on_the_smallest_tables(spark):
    import sentencepiece

    import corpus_pipeline
    from sitelake.llm import pieces
    from sitelake.llm.queries import table

    rows = [(x.doc_id, x.text, x.source) for x in table(spark, DATA, "documents").collect()]
    want = brute(rows, [(x.item_id, x.text) for x in table(spark, DATA, "benchmark").collect()])[-1]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert {x.doc_id: list(x.ids) for x in corpus_pipeline.run(spark, DATA).collect()} == {i: sp.encode(t) for i, t, _ in want}


def test_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    tables(spark, str(tmp_path), [], [(1, "x")])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_null_and_repeated_ids(spark, tmp_path):
    """Rows of one id are judged by their own text, and equal rows of a group are one."""
    import corpus_pipeline

    a, b = passage(80, 1), passage(80, 2)
    d = str(tmp_path)
    tables(spark, d, [(None, a, "s"), (None, a, "s"), (None, b, "s"), (None, "short", "s"), (5, f"{passage(60, 3)} {passage(30, 9)}", "s"), (5, "short", None)], [(1, passage(30, 9))])
    got = corpus_pipeline.run(spark, d)
    assert sorted((x.doc_id is None, x.decoded_sha256) for x in got.collect()) == sorted((True, hashlib.sha256(t.encode()).hexdigest()) for t in (a, b))


def test_tables_on_the_way_are_removed(spark, tmp_path):
    from sitelake.sources import work

    before = len(work._made)
    made = []
    out = work.settled(lambda: made.append(work.written(spark.range(3), "a")) or made[0].filter(F.col("id") > 0), "b")
    assert out.count() == 2 and len(work._made) == before + 1
    with pytest.raises(Exception):
        made[0].count()
