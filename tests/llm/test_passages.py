"""Passages that line dedup must find wherever the chunks' edges fall."""

import random

from lanewise.llm import lines
from lanewise.llm.common import table


def test_planted_passages_go_whole(spark):
    rng = random.Random(3)
    line = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    rows, want = [], {}
    for p in range(60):
        n = 1 + p % 10
        passage = [line(52 // n + 1) for _ in range(n)]
        for copy in range(2):
            before, after = [line(6) for _ in range(rng.randrange(4))], [line(6) for _ in range(1 + rng.randrange(4))]
            rows.append((2 * p + copy, "\n".join(before + passage + after)))
            want[2 * p + copy] = "\n".join(before + after) if copy else rows[-1][1]
    got = {r.doc_id: r for r in lines.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.removed_lines == (1 + d // 2 % 10 if d % 2 else 0) for d, r in got.items())


def test_repeats_in_one_text(spark):
    """The first occurrence stays, also where a line follows itself; short pairs alone stay."""
    a, b = "a " * 30, "b " * 30
    texts = ["\n".join([a, b, "x", a, b, "y"]), "\n".join(["c " * 20] * 6), "one\n" + "d " * 60, "two\n" + "d " * 60, "e f\ng h\ni", "j\ne f\ng h"]
    got = {r.doc_id: r.text for r in lines.dedupe_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == "\n".join([a, b, "x", "y"]) and set(got[1].split("\n")) == {"c " * 20} and got[2] == texts[2] and got[3] == "two"


def test_no_passage_is_left(spark, small):
    """Against a loop: of the runs of over 50 words whose pairs an earlier text has, no line stays; no line is lost."""
    texts = {r.doc_id: r.text.split("\n") for r in table(spark, small, "documents").collect()}
    got = {r.doc_id: r.text.split("\n") for r in lines.op1_line_dedup(spark, small).collect()}
    seen, runs = set(), 0
    for d in sorted(texts):
        own, i = texts[d], 0
        while i < len(own) - 1:
            j = i
            while j < len(own) - 1 and (own[j], own[j + 1]) in seen:
                j += 1
            if j > i and sum(len(x.split()) for x in own[i : j + 1]) > 50:
                runs += 1
                assert sum(own.count(x) for x in set(own[i : j + 1])) - sum(got[d].count(x) for x in set(own[i : j + 1])) >= j + 1 - i
            i = max(j, i + 1)
        seen.update(zip(own, own[1:]))
    assert runs > 2
    assert {x for t in texts.values() for x in t} - {""} == {x for t in got.values() for x in t} - {""}
