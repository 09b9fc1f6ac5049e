"""Spelling variants against all pairs of a small vocabulary, and in several rounds of filters."""

import random

from lanewise.llm import variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(count, ratio):
    rows = {}
    for w, n in count.items():
        others = [x for x in count if x != w and near(w, x)]
        best = min(others, key=lambda x: (-count[x], x), default=None)
        form = best if best is not None and count[best] >= ratio * n else None
        rows[w] = [form, n, len(others), count[form] if form else None]
    out = set()
    for w, (form, n, k, m) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.add((w, form, root, n, k, m))
    return out


def drawn(seed, n):
    r, words = random.Random(seed), {}
    for _ in range(n):
        w = "".join(r.choice("abé") for _ in range(r.randint(1, 7)))
        words[w] = r.choice((1, 2, 3, 10, 20, 200, 3000))
    return words


def test_groups_match_all_pairs(spark):
    words = drawn(1, 500) | {"a" * 90: 5, "a" * 91: 60, "a" * 45 + "b" + "a" * 45: 700, "ÿ": 3, "": 9}
    given = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("edit", variants.F.lit("clash"))
    want = brute(words, 3)
    assert {tuple(r) for r in variants.spelling_groups(given, 3).collect()} == want
    # One block a round: every edit is probed in the round of its block.
    assert {tuple(r) for r in variants.spelling_groups(given, 3, filter_bytes=4 * variants.BLOCK_BYTES).collect()} == want


def test_chains_follow_to_the_last_form(spark):
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl", "abcdefghijklm"]
    words = {w: 10**i for i, w in enumerate(chain)}
    found = variants.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n int"))
    assert {r.word: r.root for r in found.collect()} == dict.fromkeys(chain, chain[-1])


def test_few_edits_pass_in_vain(spark):
    words = spark.createDataFrame([(f"{a}{b}{c}word", 2) for a in "abcdefgh" for b in "ijklmn" for c in "opqrst"], "word string, n long")
    edits = []
    keep = variants.stage
    variants.stage = lambda df, label: edits.append(out := keep(df, label)) or out if label == "variant-edits" else keep(df, label)
    try:
        true = variants.near_pairs(words).count()
    finally:
        variants.stage = keep
    assert true == 288 * (7 + 5 + 5) // 2 and sum(e.count() for e in edits) < 1.05 * true


def test_vocabulary_of_odd_rows(spark, odd, none):
    words = {r.word: r.n for r in variants.vocabulary(odd, least_length=4).collect()}
    assert words["second"] == 2 and words["word"] == 60 and words["x" * 3000 if "x" * 3000 in words else "second"]
    assert variants.vocabulary(none).count() == 0
    assert variants.spelling_groups(variants.vocabulary(none)).count() == 0
    assert variants.spelling_groups(variants.vocabulary(odd, 4, 1)).where("word is null or root is null").count() == 0


def test_typos_go_by_the_ids_crc(spark):
    import zlib

    rows = [(i, "Ärgerlich Überraschung ABCDEFGHÉ") for i in range(200)] + [(None, "Überraschung Überraschung")]
    want = {}
    for i, text in rows:
        for run in text.split():
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            low = low if h % 31 else low[: h % len(low)] + low[h % len(low) + 1 :]
            want[low] = want.get(low, 0) + 1
    found = variants.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.word: r.n for r in found.collect()} == {w: n for w, n in want.items() if n >= 2 and len(w) >= 7}
