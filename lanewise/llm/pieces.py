"""SentencePiece encoding and decoding with a given piece table, by a relational lattice.

Texts are cut into units where no piece can cross: before each run of spaces, before line feeds, and between two
characters that stand side by side in no piece. A first pass over the texts writes the distinct units of each block of
texts, dealt to parts by a hash of the unit. The distinct units of all texts are encoded once: substrings up to the longest piece
that begins like them are exploded and equi-joined to the piece table, the edges are grouped by unit, and Spark's aggregate() folds the best path (the greatest sum of scores; of equal ones the one found
first in the order of start and length, as the library's unigram search does). The pieces then go back to the blocks,
which a second pass gives as numbers, and each block writes its texts' ids. A character without a piece becomes its
UTF-8 bytes' pieces.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, byte_length, stage, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Text characters of a block, on average; characters of a unit that is folded in Spark: longer ones, which no rule can
#: cut, are searched by the same rule in tasks.
BLOCK_CHARS, LONGEST_FOLDED = 4 << 20, 256
#: Units of texts that are spelled at a time.
TEXT_UNITS = 100_000
#: Parts that units are dealt to, at most; beyond as many blocks, a part's blocks are dealt to several groups.
MOST_PARTS = 1 << 16
#: Units of a task whose edges are grouped without a sort; units that are packed into one row a part.
UNITS_AT_ONCE, PACKED_UNITS = 50_000, 50_000
#: Fixed values of the format: the sign for a space, and what an unknown character costs below the least score.
SPACE, UNKNOWN_COST = "▁", 10.0
UNIT = re.compile(r"\n[^ \n]*| *[^ \n]+| +")
#: How an edge is packed into a long: its end, its start, and the piece's id or, from UNKNOWN on, a character's code or,
#: from ODD on, the place of a piece among those whose score doesn't follow from the id.
END, START, UNKNOWN, ODD, MASK = 44, 28, 1 << 24, 1 << 25, (1 << 28) - 1
#: Characters by which substrings are told to begin like a piece.
PREFIX = 4
WORDS = "block long, grp int, part int, words string"
TEXTS = "block long, docs binary, numbers binary, names binary"
PACKED = "part int, words string, ids binary, sizes binary"
CODED = "block long, part int, n int, ids binary, sizes binary"
IDS = "doc_id long, n_pieces int, ids array<int>, decoded_sha256 string"


class Pieces:
    """The piece table of a model file: (piece, id, score) of all ordinary pieces, and the byte pieces' ids."""

    def __init__(self, path: str = MODEL):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        self.rows = [(model.id_to_piece(i), i, float(model.get_score(i))) for i in ids if not special(i)]
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.spelled = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else b"" if special(i) else model.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        self.longest = max(len(p) for p, _, _ in self.rows)
        self.unknown = min(s for _, _, s in self.rows) - UNKNOWN_COST
        self.rank()
        self.neighbours = sorted({p[i : i + 2] for p, _, _ in self.rows for i in range(len(p) - 1)})
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p, _, _ in self.rows) or len(self.bytes) != 256 or len(self.spelled) > 1 << 16:
            raise ValueError("pieces must not cross units, every byte needs a piece, and ids must fit two bytes")

    def rank(self) -> None:
        """Codes of the pieces, and the longest piece by its first characters."""
        # Scores of merges are ranks, so an id gives its score; only the others are listed (in a unigram model nearly all).
        self.base = Counter(i + s for _, i, s in self.rows).most_common(1)[0][0]
        self.odd = [(i, s) for _, i, s in self.rows if self.base - i != s]
        odd = {i: ODD + k for k, (i, _) in enumerate(self.odd)}
        self.codes = [(p, odd.get(i, i)) for p, i, _ in self.rows]
        self.begins: dict[str, int] = {}
        for p, _, _ in self.rows:
            if len(p) >= PREFIX:
                self.begins[p[:PREFIX]] = max(len(p), self.begins.get(p[:PREFIX], 0))

    def best_path(self, word: str, table: dict[str, tuple[int, float]]) -> list[int]:
        """The same search for one long unit; negative ids are characters without a piece."""
        n = len(word)
        score, back = [0.0] + [None] * n, [(0, 0)] * (n + 1)
        for at in range(n):
            for size in range(1, min(self.longest, n - at) + 1):
                found = table.get(word[at : at + size]) or ((-ord(word[at]), self.unknown) if size == 1 else None)
                if found and (score[at + size] is None or score[at] + found[1] > score[at + size]):
                    score[at + size], back[at + size] = score[at] + found[1], (at, found[0])
        ids = []
        while n:
            n, piece = back[n]
            ids.append(piece)
        return ids[::-1]


def keys_of(text: str) -> list[str]:
    """The keys of a text's units before spaces and line feeds; the text begins as if a space stood before it.

    A key without a space before it stands for the unit with one (the usual case, found by split()); keys that begin
    with a line feed or a space are the units themselves.
    """
    if not text:
        return []
    if text[0] != " " and "  " not in text:
        return text.replace("\n", " \n").split(" ")
    return [u[1:] if u[0] == " " and " " not in u[1:] else u for u in UNIT.findall(" " + text)]


def spelled_key(key: str) -> str:
    return key.replace(" ", SPACE) if key[:1] in (" ", "\n") else SPACE + key


def keys_in_order(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The keys of all texts (none null) in order, and how many each text has."""
    plain = pc.and_(pc.greater(pc.binary_length(texts), 0), pc.invert(pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  "))))
    keys = pc.split_pattern(pc.replace_substring(texts.filter(plain), "\n", " \n"), " ")
    if len(keys) < len(texts):
        others = pa.array([keys_of(t) for t in texts.filter(pc.invert(plain)).to_pylist()], keys.type)
        is_plain = plain.to_numpy(zero_copy_only=False)
        order = np.argsort(np.concatenate((np.flatnonzero(is_plain), np.flatnonzero(~is_plain))))
        keys = pa.concat_arrays([keys, others]).take(pa.array(order))
    return keys.flatten(), keys.value_lengths().to_numpy().astype(np.int64)


def spelled_keys(keys: pa.StringArray) -> pa.StringArray:
    whole = pc.or_(pc.starts_with(keys, " "), pc.starts_with(keys, "\n"))
    return pc.if_else(whole, pc.replace_substring(keys, " ", SPACE), pc.binary_join_element_wise(SPACE, keys, ""))


def numbered(chunks: list[pa.Array]) -> tuple[np.ndarray, pa.StringArray]:
    """The number of each string, in the order of first sight, and the distinct strings."""
    found = pa.chunked_array(chunks, pa.string()).dictionary_encode().chunks
    if not found:
        return np.zeros(0, np.int64), pa.array([], pa.string())
    return np.concatenate([c.indices.to_numpy() for c in found]), found[-1].dictionary


class Cuts:
    """Cuts strings between characters that are side by side in no piece."""

    def __init__(self, neighbours: list[str]):
        chars = sorted({c for pair in neighbours for c in pair})
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        self.joined[self.kind[[ord(a) for a, _ in neighbours]], self.kind[[ord(b) for _, b in neighbours]]] = True

    def units(self, strings: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The units of all strings (none empty) in order, and how many each string has."""
        if not len(strings):
            return strings, np.zeros(0, np.int64)
        begin = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
        data, begin = memoryview(strings.buffers()[2])[begin[0] : begin[-1]], begin - begin[0]
        chars = np.frombuffer(bytes(data).decode().encode("utf-32-le"), np.uint32)
        kind, size = self.kind[chars], np.ones(len(chars), np.int32)
        for least in (0x80, 0x800, 0x10000):
            size += chars >= least
        start = np.cumsum(size, dtype=np.int32) - size  # bytes
        cut = np.concatenate(([True], ~self.joined[kind[:-1], kind[1:]]))
        cut[np.searchsorted(start, begin[:-1])] = True
        at = start[cut]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, begin[-1:])), pa.py_buffer(data)), np.diff(np.searchsorted(at, begin))


def taken(values: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches values[start : start + size] of each number in which, one after the other."""
    n = size[which]
    ends = np.cumsum(n)
    return values[np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(start[which] - (ends - n), n)]


def compressed(numbers: np.ndarray) -> bytes:
    """Numbers as four planes of bytes, so that the usual small ones leave little."""
    return pa.Codec("zstd", compression_level=3).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True)


def decompressed(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 4 * n, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(n).astype(np.int64)


def names_of(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def decoded_form(text: str) -> bytes:
    """What the decoded ids of a text spell: the sign for a space stands for one."""
    return text.replace(SPACE, " ").encode("utf-8", "surrogatepass")


def blocks(docs: DataFrame, pieces: Pieces, block_chars: int, parts: int, groups: int, with_words: bool) -> DataFrame:
    """For each block of texts its distinct units by part (WORDS), or its texts as numbers of units (TEXTS).

    Units are numbered by part and by their place in the part's row. A block is a stretch of an input partition, so
    both passes over the same files give the same blocks; encode() compares each decoded text with the one that was
    read, so that an input that changes between the passes ends in an error.
    """
    neighbours = pieces.neighbours

    def words(name: int, own: pa.StringArray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.diff(part, prepend=-1))
        n, joined = len(at), pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(at, len(own)), pa.int32()), own), " ")  # no unit has a space
        yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.int64()), pa.array([hash(name) % groups] * n, pa.int32()), pa.array(part[at], pa.int32()), joined], names_of(WORDS))

    def texts(name: int, numbers: np.ndarray, sizes: np.ndarray, n_units: int, ids: pa.Array, hashes: list) -> Iterator[pa.RecordBatch]:
        # The commonest units get the least numbers.
        names = np.argsort(-np.bincount(numbers, minlength=n_units), kind="stable")
        small = np.empty(n_units, np.int64)
        small[names] = np.arange(n_units)
        sink = pa.BufferOutputStream()
        rows = pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary())], ["doc_id", "n", "sha"])
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(rows)
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *(pa.array([x], pa.binary()) for x in (sink.getvalue().to_pybytes(), compressed(small[numbers]), compressed(names)))], names_of(TEXTS))

    def block(name: int, cuts: Cuts, keys: list[pa.Array], sizes: list[np.ndarray], ids: list[pa.Array], hashes: list) -> Iterator[pa.RecordBatch]:
        key, distinct = numbered(keys)
        found, counts = cuts.units(spelled_keys(distinct))
        of, units = numbered([found])
        part = np.fromiter(map(zlib.crc32, units.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.int64, len(units)) % parts
        order = np.argsort(part, kind="stable")
        if with_words:
            yield from words(name, units.take(pa.array(order)), part[order])
        else:
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            before = np.concatenate(([0], np.cumsum(counts[key])))[np.concatenate(([0], np.cumsum(np.concatenate(sizes))))]
            yield from texts(name, taken(rank[of], np.cumsum(counts) - counts, counts, key), np.diff(before), len(order), pa.concat_arrays(ids), hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, task, at, size = Cuts(neighbours), None, 0, 0
        held = keys, sizes, ids, hashes = [], [], [], []
        for b in batches:
            if not b.num_rows:
                continue
            task, text = b.column("task")[0].as_py(), b.column("text").fill_null("")
            own, n = keys_in_order(text)
            ends, since = np.concatenate(([0], np.cumsum(n))), 0
            for to, chars in enumerate(pc.utf8_length(text).to_pylist(), 1):
                size += chars
                if size >= block_chars or to == b.num_rows:
                    keys.append(own.slice(ends[since], ends[to] - ends[since]))
                    sizes.append(n[since:to])
                    ids.append(b.column("doc_id").slice(since, to - since))
                    if not with_words:
                        hashes.extend(hashlib.sha256(decoded_form(t)).digest() for t in text.slice(since, to - since).to_pylist())
                    since = to
                if size >= block_chars:
                    yield from block(task << 32 | at, cuts, *held)
                    held, at, size = ([], [], [], []), at + 1, 0
                    keys, sizes, ids, hashes = held
        if ids:
            yield from block(task << 32 | at, cuts, *held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("task")).mapInArrow(run, WORDS if with_words else TEXTS)


def fold_path(edges: Column, pieces: Pieces) -> Column:
    """Ids of the best path (a character without a piece: its negative code); edges: packed, in order, one at least to
    each end.

    The fold keeps the best edge to every end so far: an edge to a new end is appended, a better one to the last end
    takes its place.
    """
    node = lambda score, edge: F.struct(score.alias("score"), edge.alias("edge"))
    start_of = lambda e: F.shiftright(e, START).bitwiseAND(F.lit((1 << END - START) - 1)).cast("int")
    code_of = lambda e: e.bitwiseAND(F.lit(MASK)).cast("int")
    listed = lambda k, kind: F.split(F.lit(" ".join(repr(x[k]) for x in pieces.odd or [(0, 0)])), " ").cast(f"array<{kind}>")

    def of(code: Column, ranked: Column, unknown: Column, odd: Column) -> Column:
        return F.when(code < UNKNOWN, ranked).when(code < ODD, unknown).otherwise(F.get(odd, code - ODD))

    def score_of(code: Column) -> Column:
        return of(code, F.lit(pieces.base) - code, F.lit(pieces.unknown), listed(1, "double"))

    def step(best: Column, e: Column) -> Column:
        end = F.shiftright(e, END).cast("int")
        score = F.get(best, start_of(e))["score"] + score_of(code_of(e))
        better = F.concat(F.slice(best, F.lit(1), end), F.array(node(score, e)))
        return F.when(end == F.size(best), F.array_append(best, node(score, e))).when(score > F.get(best, end)["score"], better).otherwise(best)

    def back(best: Column) -> Column:
        return F.aggregate(
            best, F.struct((F.size(best) - 1).alias("at"), F.array().cast("array<int>").alias("ids")),
            lambda w, _: F.when(w["at"] > 0, let_edge(F.get(best, w["at"])["edge"], w["ids"])).otherwise(w), lambda w: w["ids"],
        )

    def let_edge(e: Column, ids: Column) -> Column:
        piece = of(code_of(e), code_of(e), F.lit(UNKNOWN) - code_of(e), listed(0, "int"))
        return F.struct(start_of(e).alias("at"), F.array_prepend(ids, piece).alias("ids"))

    return F.aggregate(edges, F.array(node(F.lit(0.0), F.lit(0).cast("long"))), step, back)


def encode_units(words: DataFrame, long_words: DataFrame, pieces: Pieces, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, word and ids of each distinct (keys, word); words are dealt by keys, if there are any.

    long_words are those of more than LONGEST_FOLDED characters, words the others.
    """
    spark, by = words.sparkSession, [*keys, "word"]
    # Of the model's fixed size. Pieces are met by a hash, which is a number, and then compared.
    given = F.broadcast(spark.createDataFrame(pieces.codes, "piece string, code int").select(F.xxhash64("piece").alias("hash"), "piece", "code"))
    begins = F.broadcast(spark.createDataFrame([*pieces.begins.items()] or [("", 0)], "prefix string, most int").select(F.xxhash64("prefix").alias("begin"), "most"))
    starts = words.select(*by, F.length("word").alias("n")).select(*by, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    # Beginnings are met by the hash alone: those of equal ones by chance only try more sizes.
    starts = starts.withColumn("h", F.xxhash64(F.substring("word", F.col("start") + 1, PREFIX))).join(begins, F.col("h") == F.col("begin"), "left")
    most = F.least(F.col("n") - F.col("start"), F.greatest(F.coalesce("most", F.lit(0)), F.lit(PREFIX - 1)))
    parts = starts.select(*by, "start", F.explode(F.sequence(F.lit(1), most)).alias("size"))
    parts = parts.withColumn("part_of", F.substring("word", F.col("start") + 1, F.col("size"))).withColumn("h", F.xxhash64("part_of"))
    met = parts.join(given, (F.col("h") == F.col("hash")) & (F.col("part_of") == F.col("piece")), "left").where("code is not null or size = 1")
    edge = F.shiftleft((F.col("start") + F.col("size")).cast("long"), END) + F.shiftleft(F.col("start").cast("long"), START) + F.coalesce("code", F.ascii("part_of") + UNKNOWN)
    lattices = met.select(*by, edge.alias("edge")).groupBy(*by).agg(F.sort_array(F.collect_list("edge")).alias("edges"))  # LONGEST_FOLDED * longest edges at most
    folded = lattices.select(*by, fold_path(F.col("edges"), pieces).alias("ids"))

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {p: (i, s) for p, i, s in pieces.rows}
        for b in batches:
            paths = [pieces.best_path(w.as_py(), table) for w in b.column("word")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in by), pa.array(paths, pa.list_(pa.int32()))], [*by, "ids"])

    kinds = dict(words.dtypes)
    long_ones = long_words.select(*by).mapInArrow(long, ", ".join(f"{c} {kinds[c]}" for c in by) + ", ids array<int>")
    return folded.unionByName(long_ones)


def spelled_out(ids: pa.Array, byte_ids: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after the other, with the bytes' pieces for characters without one, and the number of each list's."""
    flat, size = ids.flatten().to_numpy(), ids.value_lengths().to_numpy().astype(np.int64)
    if not len(flat) or flat.min() >= 0:
        return flat, size
    lists = [[x for i in own for x in ([i] if i >= 0 else [byte_ids[c] for c in chr(-i).encode("utf-8", "surrogatepass")])] for own in ids.to_pylist()]
    return np.array([x for own in lists for x in own], np.int64), np.array([len(own) for own in lists], np.int64)


def pack_units(coded: DataFrame, byte_ids: dict[int, int]) -> DataFrame:
    """PACKED rows of many units each, from part, word and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(part, " ".join(words), compressed(np.concatenate(ids)), compressed(np.concatenate(sizes))) for part, (words, ids, sizes) in held.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], names_of(PACKED))

        for b in batches:
            ids, n = spelled_out(b.column("ids"), byte_ids)
            part, words = b.column("part").to_numpy(), b.column("word").to_numpy(zero_copy_only=False)
            for k in np.unique(part):
                own = np.flatnonzero(part == k)
                kept = held.setdefault(int(k), ([], [], []))
                kept[0].extend(words[own])
                kept[1].append(taken(ids, np.cumsum(n) - n, n, own))
                kept[2].append(n[own])
            count += b.num_rows
            if count >= PACKED_UNITS:
                yield from flush()
                held.clear()
                count = 0
        yield from flush()

    return coded.select("part", "word", "ids").mapInArrow(run, PACKED)


def decode_ids(ids: list[int] | np.ndarray, spelled: list[bytes]) -> str:
    """The text of an encoding: its pieces without the space that every text begins with."""
    return b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, model: str = MODEL, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_pieces, ids and decoded_sha256 (of the text decoded from ids) of every row.

    Null and empty texts have no pieces; repeated rows are encoded each; other columns are ignored; an empty table
    gives no rows. A text may have any length: it lies in one block, of its own if it is longer than a block.
    """
    bounded_batches(docs.sparkSession)
    pieces = Pieces(model)
    size = docs.agg(F.coalesce(F.sum(byte_length(F.col("text"))), F.lit(0))).first()[0]
    n = size // block_chars + 1
    parts, groups = min(MOST_PARTS, n), -(-n // MOST_PARTS)
    units = stage(blocks(docs, pieces, block_chars, parts, groups, True), "piece-words")
    each = lambda rows, long: rows.select("part", F.explode(F.split("words", " ")).alias("word")).where((F.length("word") > LONGEST_FOLDED) == F.lit(long)).distinct()
    short = each(units.select("part", "words").repartition(parts, "part"), False)
    long_words = each(units.where(F.col("words").rlike(f"[^ ]{{{LONGEST_FOLDED + 1}}}")), True)
    coded = stage(pack_units(encode_units(short, long_words, pieces, ("part",)), pieces.bytes), "piece-units", {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(UNITS_AT_ONCE)})
    coded = coded.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    spelled = pieces.spelled

    def look_up(own: pa.Table, coded: pa.Table) -> pa.Table:
        known, ids, sizes = pc.split_pattern(coded.column("words").combine_chunks(), " "), [], []
        for n, packed_ids, packed_sizes in zip(known.value_lengths().to_pylist(), *(coded.column(c).to_pylist() for c in ("ids", "sizes")), strict=True):
            sizes.append(decompressed(packed_sizes, n))
            ids.append(decompressed(packed_ids, int(sizes[-1].sum())))
        flat, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (ids, sizes))
        words = pc.split_pattern(own.column("words").combine_chunks(), " ")
        which = pc.index_in(words.flatten(), value_set=known.flatten())
        if which.null_count:
            raise RuntimeError("a unit was not encoded")
        which, to = which.to_numpy().astype(np.int64), np.cumsum(words.value_lengths().to_numpy())[:-1]
        start, out = np.cumsum(n) - n, []
        for block, part, these in zip(*(own.column(c).to_pylist() for c in ("block", "part")), np.split(which, to) if len(own) else [], strict=True):
            out.append((block, part, len(these), compressed(taken(flat, start, n, these)), compressed(n[these])))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names_of(CODED))

    back = units.groupBy("grp", "part").cogroup(coded.groupBy("grp", "part")).applyInArrow(look_up, CODED)
    texts = blocks(docs, pieces, block_chars, parts, groups, False)

    def block(rows: pa.Table) -> pa.Table:
        kept = rows.filter(pc.is_valid(rows.column("ids"))).sort_by("part")
        sizes = [decompressed(s, k) for s, k in zip(kept.column("sizes").to_pylist(), kept.column("n").to_pylist(), strict=True)]
        ids = [decompressed(i, int(s.sum())) for i, s in zip(kept.column("ids").to_pylist(), sizes, strict=True)]
        flat, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (ids, sizes))
        docs_, numbers, names = (rows.column(c).drop_null()[0].as_py() for c in ("docs", "numbers", "names"))
        own = pa.ipc.open_stream(docs_).read_all()
        size = own.column("n").to_numpy()
        units = decompressed(names, len(n))[decompressed(numbers, int(size.sum()))]
        start, bounds, names_, out = np.cumsum(n) - n, np.concatenate(([0], np.cumsum(size))), names_of(IDS), []
        piece_bytes, shas, doc_ids = pa.array(spelled, pa.binary()), own.column("sha").to_pylist(), own.column("doc_id")
        at = 0
        while at < len(size):  # some texts at a time, so that what the steps hold stays small
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + TEXT_UNITS, "right")) - 1)
            these = units[bounds[at] : bounds[to]]
            ids = taken(flat, start, n, these).astype(np.uint16)
            ends = np.concatenate(([0], np.cumsum(n[these])))[bounds[at : to + 1] - bounds[at]]
            decoded = piece_bytes.take(pa.array(ids))
            byte, data = np.frombuffer(decoded.buffers()[1], np.int32)[: len(ids) + 1], memoryview(decoded.buffers()[2] or b"")
            # Without the space that every text begins with.
            hashes = [hashlib.sha256(data[a + 1 : b]).digest() for a, b in zip(byte[ends[:-1]].tolist(), byte[ends[1:]].tolist(), strict=True)]
            if hashes != shas[at:to]:
                raise RuntimeError("a decoded text differs from the text: the input changed between two passes")
            out.append(pa.table([doc_ids.slice(at, to - at), pa.array(np.diff(ends), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), pa.array([h.hex() for h in hashes], pa.string())], names=names_))
            at = to
        return pa.concat_tables(out)

    return back.unionByName(texts, allowMissingColumns=True).groupBy("block").applyInArrow(block, IDS)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
