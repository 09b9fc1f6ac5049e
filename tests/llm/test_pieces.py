"""Units of texts in whole columns against their definition, scores told by ids, and the size of the plan."""

import random

import pyarrow as pa

from lanewise.llm import pieces


def test_units_in_columns():
    rnd, model = random.Random(1), pieces.Pieces()
    texts = ["", " ", "  ", "\n", " \n ", "a  b", "a\n\nb", " a", "日本語 テ 𝄞x ümläut\n\n  two  spaces ", "▁a ▁▁ b", "x" * 50, "a \n b"]
    texts += ["".join(rnd.choice(" \nab▁日é𝄞") for _ in range(rnd.randrange(12))) for _ in range(500)]
    for some in (texts, ["plain words", "two\nlines"], ["", ""], []):
        keys, n = pieces.keys_in_order(pa.array([None, *some], pa.string()).slice(1))
        assert keys.to_pylist() == [k for t in some for k in pieces.keys_of(t)] and n.tolist() == [len(pieces.keys_of(t)) for t in some]
        spelled = pieces.spelled_keys(keys)
        assert spelled.to_pylist() == [pieces.spelled_key(k) for k in keys.to_pylist()]
        units, counts = pieces.Cuts(model.neighbours).units(spelled.slice(1))
        left, near = iter(units.to_pylist()), set(model.neighbours)
        for word, count in zip(spelled.slice(1).to_pylist(), counts.tolist(), strict=True):
            own = [next(left) for _ in range(count)]
            assert "".join(own) == word and [a[-1] + b[0] in near for a, b in zip(own, own[1:], strict=False)] == [False] * (count - 1)
            assert all(u[i : i + 2] in near for u in own for i in range(len(u) - 1))
        assert next(left, None) is None
        number, distinct = pieces.numbered([units.slice(0, 3), units.slice(3)])
        assert distinct.take(pa.array(number)).to_pylist() == units.to_pylist() and len(set(distinct.to_pylist())) == len(distinct)


def test_scores_that_no_id_tells(spark):
    """A table whose scores are no ranks (a unigram model's) gives the same paths as the plain search."""
    model = pieces.Pieces()
    model.rows = [(p, i, s if i % 3 else -float(i * 7919 % 32003) - 0.25) for p, i, s in model.rows]
    model.unknown = min(s for _, _, s in model.rows) - pieces.UNKNOWN_COST
    model.rank()
    assert len(model.odd) > 9_000
    found, words = {p: (i, s) for p, i, s in model.rows}, ["▁the", "▁tokens", "▁Straße", "\nab", "▁x日y", "▁▁b", "▁internationalisation"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    rows = {r.word: r.ids for r in pieces.encode_units(df, df.limit(0), model).collect()}
    assert rows == {w: model.best_path(w, found) for w in words}


def test_plan_holds_no_score_table(spark):
    """The driver keeps each plan's text several times, so it must not hold the scores of all pieces."""
    df = spark.createDataFrame([("▁the",)], "word string")
    assert len(pieces.encode_units(df, df, pieces.Pieces())._jdf.queryExecution().toString()) < 100_000
