"""Groups of equal texts that fit a stated part of a shard are never cut."""

from collections import Counter, defaultdict

from lanewise.llm import sharding


def test_small_groups_have_one_shard(spark):
    texts = [f"text {i} " * 12 for i in range(3000)]
    rows = texts + [t for i, t in enumerate(texts[:40]) for _ in range(1 + i % 40)] + [texts[50]] * 1000
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    shards, sizes = defaultdict(set), Counter()
    for r in sharding.shard_documents(docs).collect():
        shards[rows[r.doc_id]].add(r.shard)
        sizes[r.shard] += r.size
    assert len(shards[texts[50]]) > 1 and all(len(s) == 1 for t, s in shards.items() if t != texts[50])
    assert max(sizes.values()) / min(sizes.values()) < 1.1
