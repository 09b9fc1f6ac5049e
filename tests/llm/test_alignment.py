"""Cross-tokenizer alignment against a walk over both token lists, text by text."""

import hashlib
from collections import Counter, defaultdict

import sentencepiece
from tokenizers import Tokenizer

from lanewise.llm import alignment
from lanewise.llm.common import table


def walk(rows):
    """FOUND rows and the documents of each id pair, by the definition."""
    a_model, b_model = Tokenizer.from_file(alignment.BYTE_MODEL), sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_MODEL)
    a_model.encode_special_tokens = True
    signs, each, held = alignment.byte_signs(), [], Counter()
    for doc_id, text in rows:
        groups, a, b = [], [], []
        if text:
            a = [(i, bytes(signs[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()) for i in b_model.encode(text)]
            if b"".join(x for _, x in a) != (" " + text).encode() or b"".join(x for _, x in b) != (" " + text).encode():
                a, b = [], []
        i = j = end_a = end_b = 0
        own = ([], [])
        while i < len(a) or j < len(b):
            if end_a <= end_b and i < len(a):
                own[0].append(a[i][0])
                end_a, i = end_a + len(a[i][1]), i + 1
            else:
                own[1].append(b[j][0])
                end_b, j = end_b + len(b[j][1]), j + 1
            if end_a == end_b:
                groups.append(own)
                own = ([], [])
        each.append((doc_id, len(a), len(b), groups))
        held.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    found = []
    for doc_id, n_a, n_b, groups in each:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        found.append((doc_id, n_a, n_b, len(groups), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(found, key=repr), held


ODD = [
    (10**6, None), (10**6, ""), (None, "a b  c"), (None, None), (5, "▁x"), (6, "日本語テキスト 𝄞 ümläut\n\n  two  spaces "), (7, "<|endoftext|> <s> </s> <0x0A>"), (8, " " * 5000),
    (9, "x" * 3000 + " " * 2001 + "é" * 2000), (10, "  lead"), (11, "\x00\x01\t"), (12, "🏳️‍🌈👩‍👩‍👧" * 40), (13, "­​ ﬁ ½"), (13, "­​ ﬁ ½"), (14, "same words " * 4000),
]


def test_alignment_matches_a_walk(spark, small):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").unionByName(table(spark, small, "documents").select("doc_id", "text")).repartition(5)
    want, held = walk([tuple(r) for r in docs.collect()])
    for block_chars, some_chars in ((20_000, 7_000), (alignment.BLOCK_CHARS, alignment.SOME_CHARS)):
        found, counts = alignment.align_tokens(docs, block_chars=block_chars, some_chars=some_chars)
        assert sorted(map(tuple, found.collect()), key=repr) == want
        assert {(r.pair >> 16, r.pair & 0xFFFF): r["count"] for r in counts.collect()} == held


def test_large_groups_are_counted_by_ids(spark, small, monkeypatch):
    docs = [tuple(r) for r in table(spark, small, "documents").select("doc_id", "text").limit(40).collect()]
    aligner = alignment.Aligner(alignment.BYTE_MODEL, alignment.PIECE_MODEL)
    usual = aligner.align([t or "" for _, t in docs])
    monkeypatch.setattr(alignment, "WRITTEN_OUT", 1)
    other = aligner.align([t or "" for _, t in docs])
    for key in ("pairs", "times", "sizes"):
        assert getattr(usual, key).tolist() == getattr(other, key).tolist()
    assert int(usual.times.sum()) == int(usual.n_links.sum())


def test_odd_and_empty_tables(spark, odd, none):
    found = alignment.align_tokens(odd)[0]
    assert sorted(map(tuple, found.collect()), key=repr) == walk([(r.doc_id, r.text) for r in odd.collect()])[0]
    found, counts = alignment.align_tokens(none)
    assert found.count() == 0 == counts.count() and found.columns == [c.split(" ")[0] for c in alignment.FOUND.split(", ")]
