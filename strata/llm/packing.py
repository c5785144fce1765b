"""Packing of token sequences, best-fit decreasing with certified bin counts.

Items are dealt to partitions of bounded size; each is packed best-fit decreasing. Dual feasible functions (Fekete
and Schepers) give a lower bound on the bins that any packing of its items needs. A single partition whose count meets its bound is certified and
done. Else partitions keep their full bins and exchange the rest: the items of all bins with a gap are pooled and best-fit decreasing is run again.

That run needs no partition of its own, however many items there are. Best-fit decreasing depends on how many items there are of each length, and
there are at most as many lengths as a sequence has tokens. So the driver packs counts: bins with equal contents are one pattern with a number, each
length adds a few patterns at most, and the pool's bins are certified against the bound on its counts. Items then take the places of their length by rank.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import frugal, materialize, text_or_empty

SEQUENCE = 2048
#: Items of a partition.
DEALT = 50_000

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def special_tokens(path: str) -> dict[str, int]:
    """Ids of a tokenizer file's added tokens, which are one id wherever a text has them."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or ()
    for x in added:
        if x.get("single_word") or x.get("lstrip") or x.get("rstrip"):
            raise ValueError(f"{path}: {x['content']} isn't a plain added token")
    return {x["content"]: x["id"] for x in added}


def byte_ranks(path: str) -> dict[bytes, int]:
    """Ids by bytes, of a tokenizer file of byte-level BPE. Its ids are the ranks of its merges, which is checked."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    step = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or not step.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError(f"{path} isn't plain byte-level BPE")
    # bytes that print stand for themselves, the others for the code points from 256 on, in order
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = special_tokens(path)
    ranks = {bytes(char[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    merged = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    order = [ranks[bytes(char[c] for c in a + b)] for a, b in merged]
    if order != sorted(order):
        raise ValueError(f"{path}: ids don't follow the merges")
    return ranks


_encoders: dict = {}


def encoder(ranks: dict[bytes, int], pattern: str, special: dict[str, int] | None = None):
    """One encoder a process. tiktoken and tokenizers give the same ids for the same vocabulary (tested); it is several times as fast."""
    import tiktoken

    key = (len(ranks), pattern, tuple(sorted((special or {}).items())))
    if key not in _encoders:
        _encoders[key] = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})
    return _encoders[key]


def pieces(docs: DataFrame, tokenizer: str, pattern: str, sequence: int = SEQUENCE) -> DataFrame:
    """Every document's pieces: doc_id, piece, start, length, ids_crc32. The file's added tokens are one id each wherever a text has them; id 0
    ends a document. Only documents longer than a sequence are cut; all their pieces are whole sequences but the first."""
    known = docs.sparkSession.sparkContext.broadcast((byte_ranks(tokenizer), special_tokens(tokenizer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, special = known.value
        encode = encoder(ranks, pattern, special).encode_to_numpy
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            out = []
            for i, doc in enumerate(ids):
                tokens = np.append(encode(texts[i].as_py(), allowed_special="all"), 0).astype("<u4")
                at, end = 0, len(tokens) % sequence or sequence
                piece = 0
                while at < len(tokens):
                    out.append((doc, piece, at, end - at, zlib.crc32(tokens[at:end].tobytes())))
                    piece, at, end = piece + 1, end, end + sequence
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), PIECES.types, strict=True)], schema=PIECES) if out else pa.RecordBatch.from_pylist([], schema=PIECES)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(frugal(run), _PIECES_DDL)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins. Bins are kept by the room they have left; a bit set says which rooms occur."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, count = capacity, count, count + 1
        bins[i], offsets[i] = b, capacity - room
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins, offsets, count


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """The best bound of three families of dual feasible functions, from the number of items of each length."""
    lengths = [(x, int(n)) for x, n in enumerate(count) if n]
    x, n = (np.array(c, object) for c in (zip(*lengths, strict=True) if lengths else ((), ())))  # plain integers: sums can be large
    best = -(-int((n * x).sum()) // capacity)
    whole, most = np.array(x, np.int64), int(n.sum()) if len(n) else 0
    n = np.array(n, np.int64) if most * capacity * 64 < 1 << 62 else n
    for t in range(1, capacity // 2 + 1):  # long items count whole, short ones not at all
        value = np.where(whole > capacity - t, capacity, np.where(whole < t, 0, whole))
        best = max(best, -(-int((n * value).sum()) // capacity))
    for k in range(1, 65):  # rounded to k-ths
        value = np.where((whole * (k + 1)) % capacity == 0, whole * k, ((k + 1) * whole) // capacity * capacity)  # times k
        best = max(best, -(-int((n * value).sum()) // (capacity * k)))
    return best


def best_fit_by_count(count: np.ndarray, capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """best_fit_decreasing of so many items of each length: (number of bins, ((length, items), ...) of each of them) for each pattern.

    An item goes to the tightest bin, which then is tighter still, so a bin takes all items of a length that it has room for before the
    next one does: bins of one pattern stay alike, but for one that is left half filled."""
    by_room: dict[int, list[tuple[int, tuple]]] = {capacity: []}

    def put(room: int, bins: int, pattern: tuple) -> None:
        if bins:
            by_room.setdefault(room, []).append((bins, pattern))

    for n in range(len(count) - 1, 0, -1):
        left = int(count[n])
        for room in sorted(r for r in by_room if r >= n) if left else ():
            each, groups = room // n, by_room.pop(room)
            while groups and left:
                bins, pattern = groups.pop()
                full = min(bins, left // each)
                put(room - each * n, full, (*pattern, (n, each)))
                bins, left = bins - full, left - full * each
                if bins and left:  # fewer are left than one bin takes
                    put(room - left * n, 1, (*pattern, (n, left)))
                    bins, left = bins - 1, 0
                put(room, bins, pattern)
            for bins, pattern in groups:
                put(room, bins, pattern)
            if not left:
                break
        if left:
            each = capacity // n
            put(capacity - each * n, left // each, ((n, each),))
            if left % each:
                put(capacity - left % each * n, 1, ((n, left % each),))
    return [x for groups in by_room.values() for x in groups]


#: Bits of a rank among items of one length.
_RANK_BITS = 50


def places(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> tuple[np.ndarray, ...]:
    """Where items of each length go, as sorted ranges of ranks: their begins (length, rank), items a bin, first bin, offset in a bin."""
    rows, taken, at = [], {}, 0
    for bins, pattern in patterns:
        offset = 0
        for n, each in pattern:
            rows.append(((n << _RANK_BITS) + taken.get(n, 0), each, at, offset))
            taken[n] = taken.get(n, 0) + bins * each
            offset += n * each
        at += bins
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True))


_PACKED = pa.schema([*PIECES, ("part", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("settled", pa.bool_()), ("rank", pa.int64()), ("part_bins", pa.int64()), ("part_bound", pa.int64())])
_PACKED_DDL = f"{_PIECES_DDL}, part long, bin long, offset long, settled boolean, rank long, part_bins long, part_bound long"


def pack(items: DataFrame, sequence: int = SEQUENCE, dealt: int = DEALT) -> DataFrame:
    """items (doc_id, piece, start, length, ids_crc32; 1 <= length <= sequence) with sequence_id, offset, and part_bins and part_bound: bins
    of the partition or pool that they were last packed in, and how many it needs at least. Offsets in a sequence begin at 0 and leave no gap.
    Which of equal items lies where can't be told. An empty table gives no rows, repeated rows are packed each. Other columns are ignored."""

    def run(table: pa.Table) -> pa.Table:
        # in an order that doesn't depend on how rows arrived, so that a task run again gives the same
        table = table.sort_by([(c, "ascending") for c in ("length", "ids_crc32", "doc_id", "piece")])
        lengths = table.column("length").to_numpy()
        bins, offsets, count = best_fit_decreasing(lengths, sequence)
        bound = lower_bound(np.bincount(lengths), sequence)
        fill = np.bincount(bins, weights=lengths, minlength=count)
        settled = fill[bins] == sequence
        open_ = np.flatnonzero(~settled)
        rank = np.full(len(bins), -1)
        # lengths ascend: ranks among open items of the same length
        rank[open_] = np.arange(len(open_)) - np.searchsorted(lengths[open_], lengths[open_], "left")
        extra = [bins, offsets, settled, rank, np.full(len(bins), count), np.full(len(bins), bound)]
        return pa.Table.from_arrays([*table.select(_PACKED.names[:6]).columns, *map(pa.array, extra)], schema=_PACKED)

    extra = ["sequence_id", "offset", "part_bins", "part_bound"]
    one = F.lit(1).cast("long")
    whole = items.where(F.col("length") == sequence).select(*PIECES.names, F.monotonically_increasing_id().alias(extra[0]), F.lit(0).cast("long").alias(extra[1]), one.alias(extra[2]), one.alias(extra[3]))
    left = items.where(F.col("length") < sequence)
    n = left.count()
    if not n:
        return whole
    parts = -(-n // dealt)
    into = left.select(*PIECES.names, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).alias("part"))
    packed = materialize(into.groupBy("part").applyInArrow(run, _PACKED_DDL), "packed")
    # negative, apart from the numbers of whole sequences
    number = (-1 - (F.shiftleft(F.col("part"), 24) + F.col("bin"))).alias("sequence_id")
    if parts == 1 and packed.where("part_bins = part_bound").limit(1).count():
        return whole.unionByName(packed.select(*PIECES.names, number, *extra[1:]))
    out = whole.unionByName(packed.where("settled").select(*PIECES.names, number, *extra[1:]))
    pool = packed.where("not settled")
    counted = pool.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = counted.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    before = materialize(before.select("part", "length", "n", F.coalesce("before", F.lit(0)).alias("before")), "pool")
    count = np.zeros(sequence + 1, np.int64)
    for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length
        count[r["length"]] = r["n"]
    patterns = best_fit_by_count(count, sequence)
    bins, bound = sum(b for b, _ in patterns), lower_bound(count, sequence)
    table = items.sparkSession.sparkContext.broadcast(places(patterns)) if patterns else None

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, each, first, offset = table.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            key = (length << _RANK_BITS) + batch.column("rank").to_numpy()
            i = np.searchsorted(begin, key, "right") - 1
            bin_, copy = np.divmod(key - begin[i], each[i])
            got = [-1 - (1 << 60) - (first[i] + bin_), offset[i] + copy * length]
            yield pa.RecordBatch.from_arrays([*batch.select(PIECES.names).columns, *map(pa.array, got)], schema=pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())]))

    ranked = pool.join(before, ["part", "length"]).select(*PIECES.names, (F.col("rank") + F.col("before")).alias("rank"))
    placed = ranked.mapInArrow(frugal(assign), f"{_PIECES_DDL}, sequence_id long, offset long")
    return out.unionByName(placed.withColumns({"part_bins": F.lit(bins).cast("long"), "part_bound": F.lit(bound).cast("long")})) if patterns else out


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, sequence: int = SEQUENCE) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset, part_bins, part_bound.

    A null text counts as empty and is one token, the end. A null doc_id is carried, repeated rows are packed each. An empty
    table gives no rows. Other columns are ignored.
    """
    return pack(materialize(pieces(docs, tokenizer, pattern, sequence), "pieces"), sequence)
