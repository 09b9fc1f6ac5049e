"""The pipeline's stages on odd rows and empty tables, and against plain versions on what the stage before kept."""

import hashlib
import re

import corpus_pipeline as p
from lanewise.llm import pieces
from lanewise.llm.common import stage, table
from tests.llm.test_similar import brute


def test_stages_on_odd_rows(spark, small, odd, none):
    """Every stage takes nulls, empty and very long texts, ties, repeated rows and rows without an id."""
    docs, size = odd.select(*p.COLUMNS), odd.count()
    for name, step in p.STAGES[:-1]:
        kept = stage(step(spark, docs, small), name)
        assert kept.columns == p.COLUMNS and kept.count() <= size, name
        assert name == "mixing" or kept.where("doc_id is null").count() == 1, name
        assert name in ("mixing", "simhash_near_dedup") or kept.count() == size, name
    last = p.encode(spark, docs, small).collect()
    assert len(last) == size and all(r.n_pieces == len(r.ids) for r in last)
    for name, step in p.STAGES:
        assert step(spark, none.select(*p.COLUMNS), small).count() == 0, name


def test_run_against_plain_versions(spark, small):
    """Near copies by brute force over the lines that stay; encodings by a plain search; nothing appears from nowhere."""
    docs, kept = table(spark, small, "documents"), {}
    for name, step in p.STAGES[:-1]:
        docs = stage(step(spark, docs, small), name)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    whole = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    assert set(kept["line_dedup"]) == set(kept["toxicity"]) and all(set(t.split("\n")) <= set(whole[d].split("\n")) | {""} for d, t in kept["line_dedup"].items())
    assert set(kept["simhash_near_dedup"]) == set(brute(kept["line_dedup"])[0].values())
    assert set(kept["mixing"]) <= set(kept["simhash_near_dedup"])
    model = pieces.Pieces()
    found = {x: (i, s) for x, i, s in model.rows}
    for r in p.run(spark, small).collect():
        text = kept["mixing"][r.doc_id]
        want = []
        for unit in re.findall(r"\n[^ \n]*| *[^ \n]+| +", " " + text) if text else []:
            for i in model.best_path(unit.replace(" ", pieces.SPACE), found):
                want += [i] if i >= 0 else [model.bytes[x] for x in chr(-i).encode()]
        assert r.ids == want and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
