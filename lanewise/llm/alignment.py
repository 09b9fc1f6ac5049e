"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

A pass over the texts encodes each once with both tokenizers. For some texts at a time, pandas' merge_asof finds for
each token start of one side the other side's token that covers it, keyed by document; the union of both directions are
the overlaps, and an overlap whose two tokens end at the same byte ends a group. All pairs of the two sides' tokens in a
group are links.

How many documents hold an id pair linked is counted over the corpus: each block of documents gives its distinct pairs
with their documents, these are summed by pair, and the sums go back to the blocks that asked for them, where every
document's links are read off. Only distinct pairs of blocks and the blocks' packed links are shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded_batches, stage, table
from .pieces import compressed, decompressed

BYTE_MODEL, PIECE_MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Text characters of a block and of what is aligned at a time, on average; a longer text is alone.
BLOCK_CHARS, SOME_CHARS = 4 << 20, 1 << 19
#: Groups with more links than this are counted by distinct ids instead of being written out.
WRITTEN_OUT = 4096
#: Fixed values of the formats: the sign for a space, how a byte piece is written, and the pattern that cuts a text
#: before byte pairs are merged.
SPACE, BYTE_PIECE = "▁", re.compile(r"<0x([0-9A-F]{2})>")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of this many characters, of or without white space, are merged by the slower library that is linear in them.
LONG_RUN = re.compile(r"(?<!\S)\S{1000}|(?<!\s)\s{1000}")
BLOCKS = "block long, docs binary, links binary, times binary, sizes binary, n_pairs int, pairs array<long>, held array<int>"
FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_signs() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next from
    U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bytewise:
    """A byte-level BPE vocabulary: ids and their bytes."""

    def __init__(self, path: str):
        given = json.loads(open(path, encoding="utf-8").read())
        special, signs = {x["id"] for x in given["added_tokens"]}, byte_signs()
        self.spelled = [b""] * (1 + max(given["model"]["vocab"].values()))
        for token, i in given["model"]["vocab"].items():
            if i not in special:
                self.spelled[i] = bytes(signs[c] for c in token)
        ranks = {s: i for i, s in enumerate(self.spelled) if i not in special}
        pairs = [p.split(" ") if isinstance(p, str) else p for p in given["model"]["merges"]]
        if [given["model"]["vocab"]["".join(p)] for p in pairs] != list(range(256, 256 + len(pairs))):
            raise ValueError("ids must be in the order of the merges")
        self.fast = tiktoken.Encoding("bytewise", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True  # their strings in a text are plain text

    def encode(self, text: str) -> list[int]:
        return self.slow.encode(text, add_special_tokens=False).ids if LONG_RUN.search(text) else self.fast.encode_ordinary(text)


class Piecewise:
    """A SentencePiece vocabulary: ids and their bytes."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.spelled = [bytes([int(BYTE_PIECE.fullmatch(p)[1], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]


@cache
def vocabularies(byte_model: str, piece_model: str) -> tuple[Bytewise, Piecewise]:
    """Read once a worker."""
    return Bytewise(byte_model), Piecewise(piece_model)


def joined(ids: np.ndarray, spelled: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where each token ends (after a first 0), and all tokens' bytes."""
    found = spelled.take(pa.array(ids))
    return np.frombuffer(found.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64), memoryview(found.buffers()[2] or b"").cast("B")


def run_starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 .. of each stretch, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - run_starts(size), size)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """a and b (token numbers), a_end, b_end of all overlapping tokens, in the order of the text.

    a and b: doc, at (first byte), number and end of all tokens, sorted by at; each document's begin at one byte.
    """
    left = pd.merge_asof(a, b, on="at", by="doc", suffixes=("_a", "_b"))
    right = pd.merge_asof(b, a, on="at", by="doc", suffixes=("_b", "_a"))
    both = pd.concat([left, right[left.columns]]).sort_values("at", kind="stable")
    # Tokens that start at the same byte meet in both directions.
    again = (both["number_a"].diff() == 0) & (both["number_b"].diff() == 0)
    return both[~again]


class Aligned:
    """What some texts give: for each its figures, digest, and distinct linked id pairs with the number of links."""

    def __init__(self, n_a: np.ndarray, n_b: np.ndarray, n_groups: np.ndarray, n_links: np.ndarray, digests: list, pairs: np.ndarray, times: np.ndarray, sizes: np.ndarray):
        self.n_a, self.n_b, self.n_groups, self.n_links, self.digests = n_a, n_b, n_groups, n_links, digests
        self.pairs, self.times, self.sizes = pairs, times, sizes


class Aligner:
    def __init__(self, byte_model: str, piece_model: str):
        self.a, self.b = vocabularies(byte_model, piece_model)
        self.bytes_a, self.bytes_b = (pa.array(v.spelled, pa.large_binary()) for v in (self.a, self.b))
        self.size_a = len(self.a.spelled)
        a, b = ([str(i).encode() for i in range(len(v.spelled))] for v in (self.a, self.b))
        # How ids are written: A's before another of A's or before B's, then B's before another or before a next group.
        self.written = pa.array([*(x + b"," for x in a), *(x + b"|" for x in a), *(x + b"," for x in b), *(x + b";" for x in b)], pa.large_binary())

    def encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a, b = [self.a.encode(" " + t) if t else [] for t in texts], self.b.model.encode(texts, num_threads=1)
        flat_a, flat_b = (np.fromiter((i for own in x for i in own), np.int64) for x in (a, b))
        ends_a, data_a = joined(flat_a, self.bytes_a)
        ends_b, data_b = joined(flat_b, self.bytes_b)
        at_a = at_b = 0
        for k, text in enumerate(texts):
            to_a, to_b = at_a + len(a[k]), at_b + len(b[k])
            wanted = (" " + text).encode("utf-8", "surrogatepass") if text else b""
            if data_a[ends_a[at_a] : ends_a[to_a]] != wanted or data_b[ends_b[at_b] : ends_b[to_b]] != wanted:
                a[k], b[k] = [], []
            at_a, at_b = to_a, to_b
        return a, b

    def align(self, texts: list[str]) -> Aligned:
        a, b = self.encoded(texts)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        ids_a, ids_b = (np.fromiter((i for own in x for i in own), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        frame = lambda ids, spelled, n: pd.DataFrame({"doc": np.repeat(np.arange(len(n)), n), "at": (ends := joined(ids, spelled)[0])[:-1], "end": ends[1:], "number": np.arange(len(ids))})
        met = overlaps(frame(ids_a, self.bytes_a, n_a), frame(ids_b, self.bytes_b, n_b))
        last = met[met["end_a"] == met["end_b"]]
        # Groups are stretches of both sides' tokens; each ends where both do.
        to_a, to_b = last["number_a"].to_numpy() + 1, last["number_b"].to_numpy() + 1
        p, q = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        doc = last["doc"].to_numpy()
        n_groups, n_links = (np.bincount(doc, w, len(texts)).astype(np.int64) for w in (None, p * q))
        return Aligned(n_a, n_b, n_groups, n_links, self.digests(ids_a, ids_b, p, q, n_a, n_b), *self.links(ids_a, ids_b, p, q, doc, len(texts)))

    def digests(self, ids_a: np.ndarray, ids_b: np.ndarray, p: np.ndarray, q: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list:
        """SHA-256 of each text's groups as `a1,a2|b1;a3|b2,b3`; None without tokens."""
        kinds = np.empty(len(ids_a) + len(ids_b), np.int64)
        code_a, code_b = ids_a.copy(), ids_b + 2 * self.size_a
        code_a[np.cumsum(p) - 1] += self.size_a
        code_b[np.cumsum(q) - 1] += len(self.b.spelled)
        kinds[places(run_starts(p + q), p)] = code_a
        kinds[places(run_starts(p + q) + p, q)] = code_b
        ends, data = joined(kinds, self.written)
        bounds = ends[np.concatenate(([0], np.cumsum(n_a + n_b)))].tolist()
        return [hashlib.sha256(data[x : y - 1]).digest() if y > x else None for x, y in zip(bounds[:-1], bounds[1:], strict=True)]

    def links(self, ids_a: np.ndarray, ids_b: np.ndarray, p: np.ndarray, q: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct id pairs linked in each text, one text after the other, how often each, and how many a text has."""
        few = p * q <= WRITTEN_OUT
        first_a, first_b = run_starts(p), run_starts(q)
        which = places(first_a[few], p[few])  # tokens of A, each with all of its group's of B
        times = np.repeat(q[few], p[few])
        pairs = np.repeat(ids_a[which], times) << 16 | ids_b[places(np.repeat(first_b[few], p[few]), times)]
        keys = [np.repeat(doc[few], p[few] * q[few]) << 32 | pairs]
        weights = [np.ones(len(pairs), np.int64)]
        for g in np.flatnonzero(~few).tolist():
            own_a, times_a = np.unique(ids_a[first_a[g] : first_a[g] + p[g]], return_counts=True)
            own_b, times_b = np.unique(ids_b[first_b[g] : first_b[g] + q[g]], return_counts=True)
            keys.append(int(doc[g]) << 32 | (own_a[:, None] << 16 | own_b[None, :]).ravel())
            weights.append((times_a[:, None] * times_b[None, :]).ravel())
        if len(keys) == 1:
            keys, times = np.unique(keys[0], return_counts=True)
        else:
            keys, at = np.unique(np.concatenate(keys), return_inverse=True)
            times = np.zeros(len(keys), np.int64)
            np.add.at(times, at, np.concatenate(weights))
        return keys & 0xFFFFFFFF, times, np.bincount(keys >> 32, minlength=n)


def packed_block(name: int, ids: list, parts: list[Aligned]) -> pa.RecordBatch:
    """One BLOCKS row. A pair is a << 16 | b; held: the block's documents that hold it."""
    of = lambda key: np.concatenate([getattr(p, key) for p in parts])
    pairs, number, held = np.unique(of("pairs"), return_inverse=True, return_counts=True)
    rows = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(of(k), pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")), pa.array([d for p in parts for d in p.digests], pa.binary())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "digest"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    # The pairs of the most documents get the least numbers, so that most fit few bytes.
    order = np.argsort(-held, kind="stable")
    small = np.empty(len(order), np.int64)
    small[order] = np.arange(len(order))
    binary = [sink.getvalue().to_pybytes(), compressed(small[number]), compressed(of("times")), compressed(of("sizes"))]
    lists = [pa.array([pairs[order]], pa.list_(pa.int64())), pa.array([held[order]], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *(pa.array([x], pa.binary()) for x in binary), pa.array([len(number)], pa.int32()), *lists], [c.split(" ")[0] for c in BLOCKS.split(", ")])


def aligned_blocks(docs: DataFrame, byte_model: str, piece_model: str, block_chars: int, some_chars: int) -> DataFrame:
    """BLOCKS rows; a block is a stretch of an input partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_model, piece_model)
        ids, texts, parts, size, whole, task, at = [], [], [], 0, 0, 0, 0
        for b in batches:
            if b.num_rows:
                task = b.column("task")[0].as_py()
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                ids.append(doc_id.as_py())
                texts.append(text.as_py() or "")
                size, whole = size + len(texts[-1]), whole + len(texts[-1])
                if size >= some_chars or len(texts) >= 20_000:
                    parts.append(aligner.align(texts))
                    texts, size = [], 0
                if whole >= block_chars or len(ids) >= 200_000:
                    if texts:
                        parts.append(aligner.align(texts))
                    yield packed_block(task << 32 | at, ids, parts)
                    ids, texts, parts, size, whole, at = [], [], [], 0, 0, at + 1
        if texts:
            parts.append(aligner.align(texts))
        if ids:
            yield packed_block(task << 32 | at, ids, parts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("task")).mapInArrow(run, BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, count (documents that hold it) and best (whether no pair of the same A id has a greater count)."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select(F.col("x.pairs").alias("pair"), "x.held")
    counts = stage(each.groupBy("pair").agg(F.sum("held").alias("count")), "alignment-counts")
    most = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("count").alias("most"))
    return stage(counts.withColumn("a", F.shiftright("pair", 16)).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "alignment-best")


def align_tokens(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, block_chars: int = BLOCK_CHARS, some_chars: int = SOME_CHARS) -> tuple[DataFrame, DataFrame]:
    """The FOUND row of every row of docs, and the corpus' linked pairs: pair (A's id << 16 | B's id), count, best.

    Null and empty texts, and those that a tokenizer doesn't spell back byte by byte, have no tokens: zeros and an empty
    digest. Repeated rows are documents of their own; null ids stay null; other columns are ignored; an empty table
    gives no rows.
    """
    bounded_batches(docs.sparkSession)
    blocks = stage(aligned_blocks(docs, byte_model, piece_model, block_chars, some_chars), "alignment-blocks")
    counts = pair_counts(blocks)
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    back = asked.join(counts, "pair").select("block", "place", "count", "best")  # both sides are written tables: a hot pair is split

    def read_off(rows: pa.Table) -> pa.Table:
        own = rows.filter(pc.is_valid(rows.column("docs")))
        docs_, links, times, sizes = (own.column(c)[0].as_py() for c in ("docs", "links", "times", "sizes"))
        given = rows.filter(pc.is_valid(rows.column("place")))
        place = given.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = given.column("count").to_numpy(), given.column("best").to_numpy(zero_copy_only=False)
        found = pa.ipc.open_stream(docs_).read_all()
        n = own.column("n_pairs")[0].as_py()
        links, times = decompressed(links, n), decompressed(times, n)
        doc = np.repeat(np.arange(found.num_rows), decompressed(sizes, found.num_rows))
        total = lambda x: np.add.reduceat(np.append(x[links] * times, 0), np.searchsorted(doc, np.arange(found.num_rows))) * (np.bincount(doc, minlength=found.num_rows) > 0)
        digest = [x.hex() if x else "" for x in found.column("digest").to_pylist()]
        figures = [found.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*figures, pa.array(total(best), pa.int64()), pa.array(total(count), pa.int64()), pa.array(digest, pa.string())], names=[c.split(" ")[0] for c in FOUND.split(", ")])

    whole = blocks.select("block", "docs", "links", "times", "sizes", "n_pairs")
    return back.unionByName(whole, allowMissingColumns=True).groupBy("block").applyInArrow(read_off, FOUND), counts


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))[0]
