"""Each operator on odd rows and empty tables, and against plain versions on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lanewise.llm import components, lines, mixing, pieces, quality, secrets, sharding, simhash, toxicity, warc, weighted
from lanewise.llm.common import shared_path, table

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r.doc_id: r for r in table(spark, small, "documents").collect()}


def plain_chunks(text):
    out, now, before = [], [], None
    for line in text.split("\n"):
        now.append(line)
        h = F_hash(line)
        parts = [h] if before is None else [h, before]
        if chain(parts) % 2 == 0:
            out.append(now)
            now = []
        before = h
    return out + ([now] if now else [])


def F_hash(s):
    return np.int64(np.uint64(xxhash.xxh64_intdigest(s.encode(), 42)).astype(np.int64))


def chain(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), seed)
    return seed


def plain_units(text):
    """(kind, body) and first and last line of a text's chunks of several lines and of its windows, by the definition."""
    own, at = text.split("\n"), 0
    for c in plain_chunks(text):
        if len(c) > 1:
            yield ("chunk", "\n".join(c)), at, at + len(c) - 1
        at += len(c)
    full = [i for i, x in enumerate(own) if SPACE.search(x)]
    words = lambda a, b: sum(len(SPACE.findall(own[i])) for i in full[a : b + 1])
    down = {(a, next((b for b in range(a, len(full)) if words(a, b) > 50), None)) for a in range(len(full))}
    up = {(next((a for a in range(b, -1, -1) if words(a, b) > 50), None), b) for b in range(len(full))}
    for a, b in down | up:
        if a is not None and b is not None:
            yield ("window", "\n".join(own[i] for i in full[a : b + 1])), full[a], full[b]


def plain_dedup(texts):
    units = {d: list(plain_units(t)) for d, t in texts.items()}
    keeper = {}
    for d in sorted(units):
        for u, _, _ in units[d]:
            keeper.setdefault(u, d)
    out = {}
    for d, own in units.items():
        gone, first = set(), {}
        for u, a, b in sorted(own, key=lambda x: x[1:]):
            if keeper[u] != d:
                gone.update(range(a, b + 1))
            elif u in first:
                gone.update(range(max(a, first[u] + 1), b + 1))
            else:
                first[u] = b
        out[d] = "\n".join(x for i, x in enumerate(texts[d].split("\n")) if i not in gone)
    return out


def test_line_dedup_matches_a_loop(spark, small, docs):
    got = {r.doc_id: r for r in lines.op1_line_dedup(spark, small).collect()}
    want = plain_dedup({d: docs[d].text for d in docs})
    assert {d: got[d].text for d in got} == want
    assert all(got[d].n_lines - got[d].removed_lines == (len(want[d].split("\n")) if want[d] or got[d].n_lines > got[d].removed_lines else 0) for d in got)
    for d in got:
        kept, at = set(want[d].split("\n")), 0
        if len(set(docs[d].text.split("\n"))) == len(docs[d].text.split("\n")):
            assert got[d].removed_chunks == sum(not kept & set(c) for c in plain_chunks(docs[d].text)) if want[d] else True
    assert sum(r.removed_chunks for r in got.values()) > 0


def test_line_dedup_asks_for_one_place(spark):
    """A run whose pairs come from different documents isn't repeated; one that a single document holds whole is."""
    line = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    a, b, c = line("a", 20), line("b", 20), line("c", 20)
    texts = {1: f"{a}\n{b}\nx1", 2: f"{b}\n{c}\nx2", 3: f"{a}\n{b}\n{c}\nx3", 4: f"y\n{a}\n\n{b}\n{c}\nz"}
    got = {r.doc_id: r.text for r in lines.dedupe_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == plain_dedup(texts)
    assert {a, b, c} & set(got[3].split("\n")) and not {a, b, c} & set(got[4].split("\n"))


def test_line_dedup_of_rows_without_ids(spark):
    """They are documents of their own, told apart by their text; clashing names pass through."""
    passage = "\n".join("p q r s t u v w x y z " * 3 + str(k) for k in range(3))
    rows = [(None, f"one\n{passage}", 1, "s"), (None, f"two\n{passage}", 2, "s"), (5, f"five\n{passage}", 3, "s"), (9, f"nine\n{passage}", 4, "s"), (None, None, 5, "s"), (5, f"five\n{passage}", 6, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, spans string").withColumn("id", F.lit("i")).withColumn("th", F.lit(0)).withColumn("no_id", F.lit(1)).withColumn("doc", F.lit("d")).withColumn("n_lines", F.lit(-1))
    got = {r._id: r for r in lines.dedupe_lines(docs).collect()}
    assert {k: got[k].text for k in got} == {1: "one", 2: "two", 3: f"five\n{passage}", 4: "nine", 5: None, 6: f"five\n{passage}"}
    assert got[1].removed_lines == 3 and (got[1].id, got[1].th, got[1].doc, got[1].spans) == ("i", 0, "d", "s")


def test_line_dedup_of_many_lines(spark):
    """Texts of many lines, and many rows without ids: both in bounded rows and linear time."""
    long = "\n".join(f"l{i % 5_000}" for i in range(20_000))
    docs = spark.createDataFrame([(1, long), (2, "head\n" + long)], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.dedupe_lines(docs).select("doc_id", "n_lines", "removed_lines").collect()}
    assert got[1].removed_lines == 15_000 and got[2].removed_lines == 20_000
    many = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a\nb\n"), F.col("id") % 1000).alias("text"))
    assert lines.dedupe_lines(many).count() == 100_000


def test_line_dedup_odd(odd, none):
    rows = lines.dedupe_lines(odd).collect()
    assert len(rows) == odd.count() and {"hash", "key", "at"} <= set(rows[0].asDict())
    assert next(r for r in rows if r.doc_id == 3).text is None
    assert next(r for r in rows if r.doc_id == 1).removed_lines == 0
    assert lines.dedupe_lines(none).count() == 0


def test_fingerprints(spark, small, docs):
    got = {r.doc_id: r for r in weighted.op2_fingerprints(spark, small).collect()}
    ids = sorted(docs, reverse=True)
    errors = []

    def bag(t):
        w = SPACE.findall(t)
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    for i, d in enumerate(ids):
        t, nxt = docs[d].text, docs[ids[(i + 1) % len(ids)]].text
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(t)
        for other, near in ((edited, got[d].near_edited), (nxt, got[d].near_next)):
            a, b = bag(t), bag(other)
            j = sum((a & b).values()) / max(1, sum((a | b).values()))
            errors.append(near - j)
    by_text = defaultdict(set)
    for d in docs:
        by_text[docs[d].text].add(got[d].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_weighted_collisions(spark):
    """Heavier counts weigh in: collision rates follow generalised, not plain, Jaccard similarity."""
    line = lambda i: f"common{i} words{i} of{i} one{i} line{i} "
    a = [line(i) * 8 + f"tail{i} number" for i in range(60)]
    b = [line(i) * 2 + f"tail{i} number" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(a)) + [(1000 + i, t) for i, t in enumerate(b)], "k long, text string")
    sig = {r.k: r.signature for r in weighted.signatures(df, ["k"], 64).collect()}
    est = np.mean([np.mean(np.array(sig[i]) == np.array(sig[1000 + i])) for i in range(60)])

    def bag(t):
        w = t.split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    j = np.mean([sum((bag(x) & bag(y)).values()) / sum((bag(x) | bag(y)).values()) for x, y in zip(a, b)])
    assert abs(est - j) < 0.06


def test_fingerprints_odd(spark, odd, none):
    rows = weighted.edited_pairs(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1 and set(next(r for r in rows if r.doc_id == 4).fingerprint) == {"0"}
    assert weighted.edited_pairs(none).count() == 0
    one = weighted.edited_pairs(odd.where("doc_id = 1")).first()
    assert one.near_next == 1.0


@pytest.mark.parametrize("kind", ["dense", "both ends", "outlier", "half null", "one id"])
def test_neighbours_of_any_ids(spark, kind):
    """Buckets of about equal size and the right next text, wherever the ids lie."""
    n = 3000
    ids = {
        "dense": list(range(n)), "both ends": [-9 * 10**18 + i * 10**6 if i % 2 else 9 * 10**18 - i * 10**6 for i in range(n)], "outlier": [10**15, *range(n - 1)],
        "half null": [None if i % 2 else i for i in range(n)], "one id": [7 if i % 3 else i + 10**6 for i in range(n)],
    }[kind]
    df = spark.createDataFrame([(d, f"text {i}") for i, d in enumerate(ids)], "doc_id long, text string").repartition(5)
    rows = weighted.neighbours(df, bucket_rows=50).collect()
    sizes = Counter(r.bucket for r in rows)
    assert max(sizes.values()) <= 4 * 50 and sum(r.extra for r in rows) == len(sizes)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = [t for _, _, t in sorted((d is None, -(d or 0), (hashes[f"text {i}"], f"text {i}")) for i, d in enumerate(ids))]
    want = {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert {r.text: r.next for r in rows if not r.extra} == want


def test_pieces(spark, odd, none):
    table_ = pieces.Pieces()
    found = {p: (i, s) for p, i, s in table_.rows}
    rows = pieces.encode(odd, block_chars=1000).collect()
    assert len(rows) == odd.count()
    texts = defaultdict(set)
    for r in odd.collect():
        texts[r.doc_id].add(r.text or "")
    for r in rows:
        (t,) = texts[r.doc_id]
        want = []
        for u in pieces.keys_of(t):  # whole, not cut between characters
            for i in table_.best_path(pieces.spelled_key(u), found):
                want += [i] if i >= 0 else [table_.bytes[x] for x in chr(-i).encode()]
        assert r.ids == want and r.n_pieces == len(want) and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert pieces.encode(none).count() == 0


def test_best_path_is_best():
    """The search against all segmentations of short units."""
    t = pieces.Pieces()
    found = {p: (i, s) for p, i, s in t.rows}

    def best(w):
        if not w:
            return 0.0
        return max((found[w[:k]][1] if w[:k] in found else t.unknown) + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in found or k == 1)

    score = {i: s for _, i, s in t.rows}
    for w in ("▁the", "▁tokens", "▁Straße", "\nab", "▁x日y", "▁▁b"):
        assert sum(score.get(i, t.unknown) for i in t.best_path(w, found)) == best(w)


def test_warc(spark, tmp_path):
    pages = [(i, f"http://e/{i}", "x" * 200 if i % 3 else f"<p>{i}</p>", 1) for i in range(40)] + [(None, None, "y" * 200, 1), (50, "u\r\nInjected: 1", None, 1), (51, "u", "y" * 200, 1), (51, "u", "y" * 200, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest int")
    path = shared_path(spark, "warc")
    warc.write_warc(df, path, archive_bytes=2000)
    rows = warc.read_warc(spark, path).collect()
    assert len(rows) == len(pages)
    assert sorted((r.page_id or -1) for r in rows if r.record_type == "response" and r.payload_bytes == 200) == [-1, 1, 51, 51]
    assert all(r.refers_to == 1 and r.payload is None for r in rows if r.record_type == "revisit")
    assert next(r for r in rows if r.page_id == 50).url == "u\r\nInjected: 1"
    assert {(r.page_id, bytes(r.payload).decode()) for r in rows if r.record_type == "response" and r.page_id and r.page_id % 3 == 0 and r.page_id < 40} == {(i, f"<p>{i}</p>") for i in range(3, 40, 3)}
    empty = shared_path(spark, "warc")
    warc.write_warc(df.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_dictionary(spark, small):
    path = shared_path(spark, "warc")
    warc.write_warc(table(spark, small, "pages"), path)
    data = spark.read.format("binaryFile").load(path).where("length > 0").first().content
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC and int.from_bytes(data[4:8], "little") > 1000
    assert len(list(warc.frames(bytes(data)))) == table(spark, small, "pages").count()


def test_sharding(spark, small, docs, odd, none):
    rows = sharding.op5_sharding(spark, small).collect()
    assert {r.doc_id for r in rows} == set(docs) and {r.law for r in rows} == {"bytes"}
    sizes, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        t = docs[r.doc_id].text
        assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode()) and r.grown_shard is None
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[t].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows)
    assert sharding.shard_documents(odd).count() == odd.count() and sharding.shard_documents(none).count() == 0


def test_placement_balances_all_three():
    rng = np.random.default_rng(0)
    items = np.column_stack([rng.lognormal(8, 1, 3000), rng.lognormal(6, 1, 3000), rng.integers(1, 4, 3000)])
    at = sharding.place(items, 16)
    for k, most in ((0, 1.02), (1, 1.15), (2, 1.3)):
        load = np.bincount(at, weights=items[:, k], minlength=16)
        assert load.max() / load.mean() < most


def test_hot_group_is_cut(spark):
    df = spark.createDataFrame([(i, "same text " * 20 if i % 2 else f"text {i} " * 15) for i in range(4000)], "doc_id long, text string")
    sizes = [r.s for r in sharding.shard_documents(df).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 16 and max(sizes) / min(sizes) < 1.1


def test_toxicity_held_out(spark, small, odd, none):
    sf = "/root/testdata/sf0.01"
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    marked = toxicity.mark_toxic(d.join(labels.where("doc_id % 3 = 1"), "doc_id", "left_semi"), labels.where("doc_id % 3 <> 1"))
    # Trained on labels of documents it does not see, nothing is known:
    assert marked.where("_toxic.toxic").count() == 0
    held = toxicity.mark_toxic(d, labels.where("doc_id % 3 <> 1")).join(labels.where("doc_id % 3 = 1"), "doc_id").select("toxic", F.col("_toxic.toxic").alias("said")).collect()
    right = sum(bool(r.toxic) == r.said for r in held) / len(held)
    assert right > 0.93 and sum(r.said and not r.toxic for r in held) <= 1
    assert toxicity.mark_toxic(odd, labels.limit(0)).count() == odd.count()
    # Odd rows through a trained chain: repeated rows alike, empty texts clean, ids of labels that repeat.
    given = d.select("doc_id", "text").unionByName(odd.select(F.col("doc_id") + 10**9, "text").toDF("doc_id", "text"))
    marked = toxicity.mark_toxic(given, labels.unionByName(labels))
    rows = marked.where("doc_id > 1000000000 or doc_id is null").select("doc_id", "text", "_toxic.*").collect()
    assert len(rows) == odd.count() and not any(r.toxic for r in rows if not (r.text or "").strip())
    assert len({r.p_toxic for r in rows if r.doc_id in (10**9 + 6, 10**9 + 7)}) == 1
    assert toxicity.mark_toxic(none, labels).count() == 0


def test_toxicity_recall_on_held_out_labels(spark):
    """Trained on one half of the labels, at least nine in ten toxic documents of the other are found."""
    sf = "/root/testdata/sf0.1"
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = toxicity.mark_toxic(d.join(labels, "doc_id", "left_semi"), labels.where("doc_id % 2 = 1")).join(labels.where("doc_id % 2 = 0"), "doc_id").select("toxic", F.col("_toxic.toxic").alias("said")).collect()
    assert sum(r.said for r in held if r.toxic) >= 0.9 * sum(r.toxic for r in held) and sum(r.said for r in held if not r.toxic) <= 0.01 * len(held)


def test_toxicity_is_the_plain_chain(spark):
    """The whole query on a small table against the same steps written plainly: counts, odds, chain, probabilities."""
    words = [f"word{i}" for i in range(40)]
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(words, 12)) + (" vile" if i % 4 == 0 else "") for i in range(120)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 and 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(d, labels)
    fold = {r.doc_id: r.fold for r in toxicity.labelled_sample(d, labels, 1000).collect()}
    seen = Counter(t for x in texts for t in toxicity.terms_of(x))

    def odds(leave):
        ids = [i for i in range(120) if fold[i] != leave]
        out = {}
        for t in chain.odds:
            have = [i for i in ids if t in toxicity.terms_of(texts[i])]
            if len(have) > 1:
                out[t] = tuple(
                    np.log((sum(y(i) for i in have) + 0.5) / (sum(y(i) for i in ids) + 1)) - np.log((len(have) - sum(y(i) for i in have) + 0.5) / (len(ids) - sum(y(i) for i in ids) + 1))
                    for y in (lambda i: i % 4 == 0, lambda i: i % 3 == 0)
                )
        return out

    assert set(chain.odds) == {t for t, n in seen.items() if n > 2}
    z = np.array([toxicity.summary(toxicity.terms_of(texts[i]), odds(fold[i])) for i in range(120)])
    z = (z - z.mean(0)) / np.maximum(z.std(0), 1e-6)
    folds = np.array([fold[i] for i in range(120)])
    toxic, low = np.array([int(i % 4 == 0) for i in range(120)]), np.array([int(i % 3 == 0) for i in range(120)])
    for w, y in zip(chain.weights, (toxic, toxic * (1 - low), toxic * low), strict=True):
        x = np.column_stack([np.ones(len(z)), z])
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + np.r_[1e-6, np.full(x.shape[1] - 1, toxicity.RIDGE)] * w
        assert np.abs(gradient).max() < 1e-4  # the ridge optimum of the chain's columns
        unseen = np.zeros(len(z))
        for k in range(toxicity.FOLDS):
            unseen[folds == k] = toxicity.sigmoid(toxicity.with_one(z[folds == k]) @ toxicity.fit_logistic(z[folds != k], y[folds != k]))
        z = np.column_stack([z, unseen])


def plain_fingerprint(text):
    w = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def linked(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    v = np.array([fps[i] for i in ids], dtype=np.uint64)
    for a in range(len(ids)):
        for b in np.nonzero(np.bitwise_count(v[a + 1 :] ^ v[a]) <= 2)[0]:
            x, y = find(ids[a]), find(ids[a + 1 + b])
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark, small, docs):
    got = {r.doc_id: r for r in simhash.op7_simhash(spark, small).collect()}
    fps = {d: plain_fingerprint(docs[d].text) for d in docs}
    assert {d: got[d].fingerprint for d in got} == {d: format(x, "016x") for d, x in fps.items()}
    assert {d: got[d].component_id for d in got} == linked(fps)


@pytest.mark.parametrize("most", [1, 6, 48])
def test_all_close_pairs_are_linked(spark, most):
    """Clusters of near fingerprints, paired or met in points: the same components as by brute force."""
    rng = np.random.default_rng(most)
    fps = {}
    for c in range(8):
        base = int(rng.integers(0, 1 << 62))
        for _ in range(20):
            x = base
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                x ^= 1 << int(b)
            fps.setdefault(len(fps), x)
    df = spark.createDataFrame([(i, int(np.uint64(x).astype(np.int64))) for i, x in fps.items()], "i long, fp long")
    label = {r.node: r.label for r in components.components(simhash.near_links(df.select("fp").distinct(), most)).collect()}
    mine = {i: label.get(int(np.uint64(x).astype(np.int64)), int(np.uint64(x).astype(np.int64))) for i, x in fps.items()}
    want = linked(fps)
    assert len({(mine[i], want[i]) for i in fps}) == len(set(want.values())) == len(set(mine.values()))


def test_components(spark):
    chain_ = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 300), (None, 5)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(chain_, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_odd(odd, none):
    rows = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert rows[2].component_id == 1 and rows[7].component_id == 6 and rows[3].component_id == rows[4].component_id == rows[5].component_id == 3 and rows[3].fp == 0
    assert simhash.near_duplicates(none).count() == 0


def test_quality_base(spark, small, docs):
    for r in quality.op8_quality(spark, small).collect():
        t = docs[r.doc_id].text
        w = SPACE.findall(t)
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(g)
        held = {i + k for i, x in enumerate(g) if c[x] > 1 for k in range(3)}
        own = [x for x in t.split("\n") if SPACE.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(held))
        assert r.base_failed == (len(w) < 50 or 100 * len(held) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_quality_rejects_outliers(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op8_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1) and sum(not r.kept for r in rows if r.quality == 0) > 0.9 * sum(r.quality == 0 for r in rows)


def test_mcd_of_a_contaminated_group(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 5))
    x[:80] += 15
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, x0 double, x1 double, x2 double, x3 double, x4 double")
    e = quality.mcd(df).first()
    assert all(abs(e[f"m{i}"]) < 0.35 for i in range(5)) and 0.3 < e.l00 < 1.5


def plain_mcd(x, keep, steps):
    """The same estimate in plain numpy: subsets end with a whole distance bin; returns mean, covariance and scale."""
    floors = np.diag(np.square(quality.FLOORS))
    low = lambda v: np.sort(np.round(v * quality.GRID))[(len(v) - 1) // 2] / quality.GRID
    centre = np.array([low(x[:, i]) for i in range(5)])
    mad = np.array([low(np.abs(x[:, i] - centre[i])) for i in range(5)])
    best = None
    for start, (m, c) in enumerate([(x.mean(0), np.cov(x.T, bias=True) + floors), (centre, np.diag((1.4826 * mad) ** 2) + floors)]):
        for _ in range(steps):
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            bins = np.floor(np.log2(d2 + 1e-6) * quality.BINS_PER_OCTAVE)
            edge = max(b for b in set(bins) if (bins < b).sum() < keep * len(x))
            own = x[bins <= edge]
            m, c = own.mean(0), np.cov(own.T, bias=True).reshape(5, 5) + floors
        found = (np.log(np.linalg.det(c)) / 2, start, m, c, 2.0 ** ((edge + 1) / quality.BINS_PER_OCTAVE))
        best = found if best is None or found[:2] < best[:2] else best
    return best[2:]


def test_groups_of_every_size(spark):
    """Groups of 5 to 400 rows against plain numpy, estimates and shrinkage alike."""
    rng = np.random.default_rng(3)
    rows = []
    for g, (lang, n) in enumerate([("a", 5), ("a", 17), ("a", 60), ("b", 400), ("b", 9), ("c", 1)]):
        x = rng.normal(g, 1 + 0.1 * g, (n, 5))
        x[: n // 6] += 12
        rows += [(lang, f"s{g}", *map(float, r)) for r in x]
    df = spark.createDataFrame(rows, "l string, s string, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = {(r.l, r.s): r for r in quality.group_limits(df).collect()}
    of = lambda keep: np.array([r[2:] for r in rows if keep(r)])
    draw = lambda own, n, parent: tuple((n * a + quality.PRIOR_ROWS * b) / (n + quality.PRIOR_ROWS) for a, b in zip(own, parent, strict=True))
    every = plain_mcd(of(lambda r: True), quality.KEEP, quality.STEPS)
    assert len(got) == 6
    for (lang, source), r in got.items():
        of_lang, mine = of(lambda q: q[0] == lang), of(lambda q: q[:2] == (lang, source))  # noqa: B023
        m, c, scale = draw(plain_mcd(mine, quality.KEEP, quality.STEPS), len(mine), draw(plain_mcd(of_lang, quality.KEEP, quality.STEPS), len(of_lang), every))
        low = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        assert np.allclose([r[f"m{i}"] for i in range(5)], m) and np.allclose(low @ low.T, c) and np.isclose(r.scale, scale), (lang, source)


def test_quality_odd(odd, none):
    rows = quality.quality_rules(odd).collect()
    assert len(rows) == odd.count() and not next(r for r in rows if r.doc_id == 3).kept and "key" not in rows[0].asDict()
    assert quality.quality_rules(none).count() == 0


def test_mixing_odd(odd, none):
    rows = mixing.select_mix(odd, budget_share=1.0, max_epochs=1).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "2", "6", "7", "7", "None", "8", "9", "10"]) and {"at", "n", "id"} <= set(rows[0].asDict())
    assert mixing.select_mix(none).count() == 0


def test_shortages_stay_among_siblings(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d1", "en", "a", 1000)], "domain string, lang string, source string, supply long")
    got = {(r.domain, r.source): r.tokens for r in mixing.budgets(leaves, F.lit(400).cast("long"), {"domain": {"d0": 1, "d1": 1}}, 1).collect()}
    assert got == {("d0", "a"): 10, ("d0", "b"): 190, ("d1", "a"): 200}
    over = {(r.domain, r.source): r.tokens for r in mixing.budgets(leaves, F.lit(4000).cast("long"), {}, 1).collect()}
    assert over == {("d0", "a"): 10, ("d0", "b"): 1000, ("d1", "a"): 1000}


@pytest.mark.parametrize("stretch", [4, 64, 100_000])
def test_stretches_change_nothing(spark, small, stretch):
    d = table(spark, small, "documents")
    key = lambda df: sorted((r.doc_id, r.epoch) for r in df.select("doc_id", "epoch").collect())
    assert key(mixing.select_mix(d, stretch_rows=stretch)) == key(mixing.select_mix(d))


def test_secrets(spark, small, odd, none):
    sf = "/root/testdata/sf0.01"
    rows = secrets.op10_secrets(spark, sf).collect()
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in rows:
        found = texts[r.doc_id][r.at : r.at + r.length]
        assert hashlib.sha256(found.encode()).hexdigest() == r.found_sha256
        assert r.is_secret == bool(re.fullmatch("[0-9A-Fa-f]{40}", found))
    assert len(rows) == sum(len(re.findall(secrets.CANDIDATE, t or "")) for t in texts.values())
    assert secrets.scan_secrets(odd).count() == 0 and secrets.scan_secrets(none).count() == 0


def test_repeated_rows_score_alike(spark):
    """Features depend on the text alone: repeated rows, and rows without an id, get the same as a single one."""
    text = "the token = a1b2c3d4e5f6a7b8c9d0words here"
    one = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    known = spark.createDataFrame([("words",)], "w string")
    f = lambda rows: {tuple(r[c] for c in secrets.NUMERIC) for r in secrets.features(secrets.candidates(spark.createDataFrame(rows, "doc_id long, text string")), known).collect()}
    assert one.count() == 1 and f([(1, text)]) == f([(1, text), (1, text), (None, text), (None, text)])


def test_secrets_labelled(spark):
    docs = spark.createDataFrame([(i, f"see {'a1b2c3d4' * 3} here" if i % 2 else f"key = {'f9e8d7c6' * 5} end") for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "case when doc_id % 2 = 1 then 4L else 6L end as at", "1 - doc_id % 2 as label").where("doc_id < 20")
    assert {(r.doc_id % 2, r.is_secret) for r in secrets.scan_secrets(docs, labels).collect()} == {(0, True), (1, False)}
