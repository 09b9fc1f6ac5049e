"""The pipeline's near-dedup against a brute-force pairing by exact similarity."""

import random

import numpy as np

from lanewise.llm import similar
from lanewise.llm.common import table


def bag(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    ids = sorted(texts)
    sets, root = {i: bag(texts[i]) for i in ids}, {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
                continue
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                pairs += x != y
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, pairs


def planted():
    """Texts with a share of words changed, so that similarities lie around 0.8, and a crowd of copies of one text."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    out = {}
    for group in range(30):
        base = [word() for _ in range(rng.randrange(40, 200))]
        for _ in range(3 if group else 70):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(own) // 25))):
                own[rng.randrange(len(own))] = word()
            out[len(out)] = " ".join(own)
    return out | {len(out): "", len(out) + 1: " \n", len(out) + 2: "one two"}


def test_planted(spark):
    texts = planted()
    want, pairs = brute(texts)
    got = {r.doc_id: r.component_id for r in similar.near_texts(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert pairs > 100 and got == want


def test_planted_in_small_cells(spark):
    texts = planted()
    # A passage that unlike texts share makes a crowd whose members stay apart but for a few.
    rng, passage = random.Random(6), " ".join(f"p{i}" for i in range(12))
    for _ in range(60):
        texts[len(texts)] = passage + " " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 60)))
    for i in range(5):
        texts[len(texts)] = texts[len(texts) - 60] + f" end{i}"
    want, _ = brute(texts)
    got = {r.doc_id: r.component_id for r in similar.near_texts(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), cell=4).collect()}
    assert got == want


def test_cells_lose_no_pair(spark):
    """All pairs of a crowded group with different labels that sizes and maps let through, whatever the cells hold."""
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 400)
    nodes, rows = {}, []
    for i in range(90):
        own = np.unique(np.concatenate([base[: int(rng.integers(30, 400))], rng.integers(-(2**62), 2**62, 6)]))
        nodes[i] = (len(own), similar.brief_map(similar.bit_map(own)))
        rows += [(g, size, i, int(i % 7)) for g, size in ((1, 90), (2, 30)) if g == 1 or i < 30]
    held = spark.createDataFrame(rows, "g long, size long, node long, label long")
    known = spark.createDataFrame([(i, n, m.tolist()) for i, (n, m) in nodes.items()], "node long, n int, brief array<long>")

    def close(i, j):
        (n, x), (m, y) = nodes[i], nodes[j]
        k = min(len(x), len(y))
        fold = lambda z: z.reshape(-1, k)[0] | z.reshape(-1, k)[-1]
        return 5 * min(n, m) >= 4 * max(n, m) and 9 * sum(int(v).bit_count() for v in (fold(x) ^ fold(y)).view(np.uint64)) <= n + m

    want = {(i, j) for i in nodes for j in nodes if i < j and i % 7 != j % 7 and close(i, j)}
    for cell in (5, 40, 1000):
        assert {tuple(r) for r in similar.apart_pairs(held, known, cell).collect()} == want and want


def test_hub(spark):
    """One node with 200,000 links, and a chain on it."""
    from lanewise.llm.components import components

    links = spark.range(1, 200_001).selectExpr("0L a", "id b").unionByName(spark.range(200_000, 200_050).selectExpr("id a", "id + 1 b"))
    got = components(links)
    assert got.count() == 200_051 and got.where("label <> 0").count() == 0


def test_stage_against_brute_force(spark, small):
    import corpus_pipeline

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want, pairs = brute({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, small).collect()}
    assert pairs > 0 and got == set(want.values())


def test_odd(odd, none):
    rows = {r.doc_id: r for r in similar.near_texts(odd).collect()}
    assert rows[2].component_id == 1 and rows[7].component_id == 6 and rows[3].component_id == rows[4].component_id == rows[5].component_id == 3
    assert similar.near_texts(odd).count() == odd.count() and similar.near_texts(none).count() == 0


def test_rows_without_ids_and_repeated_rows(spark):
    """One row of each group stays, whatever its id: copies without an id, equal ids of different texts, repeated rows."""
    import corpus_pipeline

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (None, a), (None, b), (1, a), (1, b), (None, None), (9, ""), (3, b + " tail")]
    docs = spark.createDataFrame([(d, t, "en", "src1", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id", "text").collect()
    assert sorted((r.doc_id, (r.text or "")[:1]) for r in kept) == [(1, "a"), (1, "b"), (9, "")]
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0
