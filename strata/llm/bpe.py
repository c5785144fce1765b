"""Byte-level BPE as Spark expressions over distinct words, and decoding.

A text is split into words by the tokenizer's pattern; a word's ids depend on nothing else. So words are counted, and the
frequent ones, up to a fixed number, are encoded once each by higher-order functions: a fold over the word's bytes merges, step by step, the pair
of lowest rank, with ranks looked up in a literal map. That dictionary has a bounded size and goes to all tasks, which put texts together from
it. A word that isn't among the frequent ones is folded in the same way where it occurs, so every text is encoded in full, and no text is shuffled.
Ids are decoded by an expression that concatenates the bytes they stand for, looked up in a literal array.
"""

from __future__ import annotations

import base64
import heapq
import json
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize, text_or_empty

#: Words of the dictionary at most, and bytes of one of them; words seen less often in ROWS rows aren't candidates.
WORDS, WORD_BYTES, SEEN = 350_000, 64, 2
#: Other words whose ids a process keeps for a while.
MEMO = 60_000
#: Rows that a task handles at once.
ROWS = 2000
_SLOTS = 1 << 14


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by bytes, of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: an array of small maps, since a lookup in a map is linear. Bytes are written as Latin-1."""
    slots: list[dict[str, int]] = [{} for _ in range(_SLOTS)]
    for token, rank in ranks.items():
        slots[zlib.crc32(token.decode("latin-1").encode()) % _SLOTS][token.decode("latin-1")] = rank
    return F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")


def encoded(word: Column, ranks: Column) -> Column:
    """Ids (array of ints) of a column of words: non-empty strings, each one match of the pattern."""
    none = F.lit(2**31 - 1)

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def fold(table: Column, text: Column) -> Column:
        def rank(s: Column) -> Column:
            slot = F.get(table, (F.crc32(F.encode(s, "UTF-8")) % _SLOTS).cast("int"))
            return F.coalesce(F.try_element_at(slot, s), none)

        n = F.length(text)

        def step(state: Column, _: Column) -> Column:
            def merge(least: Column) -> Column:
                def at(p: Column) -> Column:
                    one = F.get(state["parts"], p - 1)
                    joined = F.concat(one, F.get(state["parts"], p))

                    def rebuilt(new: Column) -> Column:
                        before = F.when(p > 1, F.array(rank(F.concat(F.get(state["parts"], p - 2), new)))).otherwise(F.array().cast("array<int>"))
                        after = F.when(p < F.size(state["ranks"]), F.array(rank(F.concat(new, F.get(state["parts"], p + 1))))).otherwise(F.array().cast("array<int>"))
                        return F.struct(
                            F.concat(F.slice(state["parts"], 1, p - 1), F.array(new), F.slice(state["parts"], p + 2, n)).alias("parts"),
                            F.concat(F.slice(state["ranks"], 1, F.greatest(p - 2, F.lit(0))), before, after, F.slice(state["ranks"], p + 2, n)).alias("ranks"),
                        )

                    return let(joined, rebuilt)

                return F.when(F.coalesce(least, none) < none, let(F.array_position(state["ranks"], least).cast("int"), at)).otherwise(state)

            return let(F.array_min(state["ranks"]), merge)

        parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(1)))
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: rank(F.substring(text, i, F.lit(2))))).otherwise(F.array().cast("array<int>"))
        merged = F.aggregate(F.sequence(F.lit(1), n), F.struct(parts.alias("parts"), pairs.alias("ranks")), step, lambda s: F.transform(s["parts"], rank))
        return F.when(rank(text) < none, F.array(rank(text))).otherwise(merged)

    latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    return let(ranks, lambda table: let(latin, lambda text: fold(table, text)))


def fold_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the pair of lowest rank is merged, the first of equals, until none has a rank. A heap of pairs
    keeps long words from costing the square of their length."""
    if word in ranks:
        return [ranks[word]]
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    if len(word) <= 48:
        none, get = 1 << 31, ranks.get
        pairs = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size:
            continue  # one of the pair has been merged since
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
    return [ranks[p] for p in parts if p is not None]


def _count(pattern: str, seen: int, most: int):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        for part in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            words: Counter = Counter()
            for text in part.column("text"):
                words.update(find(text.as_py()))
            words = {w: n for w, n in words.items() if n >= seen and len(w) <= most and len(w.encode()) <= most}
            yield pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], schema=schema)

    return frugal(count)


def dictionary(texts: DataFrame, pattern: str, ranks: dict[bytes, int], words: int = WORDS) -> dict[str, bytes]:
    """Ids (little-endian, 32 bits each) of frequent words, `words` at most. Which words are in it changes how fast texts are encoded, not what comes out."""
    counts = materialize(texts.mapInArrow(_count(pattern, SEEN, WORD_BYTES), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # from how often on: counts are grouped by their logarithm, in eighths of a doubling
    step = F.floor(F.log2("n") * 8).cast("int")
    least, total = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        if total + r["count"] > words:
            break
        least, total = r["step"], total + r["count"]
    if least is None:
        return {}
    frequent = counts.where(step >= least).repartition(max(1, total // 4000))
    got = frequent.select("word", encoded(F.col("word"), _rank_map(ranks)).alias("ids")).toArrow()
    return {w: np.asarray(i, "<u4").tobytes() for w, i in zip(got.column("word").to_pylist(), got.column("ids").to_pylist(), strict=True)}


class _Words(dict):
    """Ids by word; those of other words are folded when asked for, and the latest of them are kept, MEMO at most."""

    def __init__(self, known: dict[str, bytes], ranks: dict[bytes, int]):
        super().__init__(known)
        self.ranks, self.memo = ranks, {}

    def __missing__(self, word: str) -> bytes:
        found = self.memo.get(word)
        if found is None:
            ids = fold_bytes(word.encode(), self.ranks)
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= WORD_BYTES:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = found
        return found


_state: dict = {}


def encode(docs: DataFrame, path: str, pattern: str, words: int = WORDS) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) and tokens (the same as an array of ints) of every row.

    A null text counts as empty and has no ids. A null doc_id is carried, repeated rows are encoded each. An empty table gives no rows.
    Other columns are ignored. Strings of special tokens are ordinary text.
    """
    sc = docs.sparkSession.sparkContext
    ranks = load_ranks(path)
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    known = sc.broadcast((dictionary(texts.select("text"), pattern, ranks, words), ranks))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("tokens", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        if _state.get("id") is not known:
            _state.clear()
            _state.update(id=known, words=_Words(*known.value))
        ids_of = _state["words"].__getitem__
        for part in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            ids = [b"".join(map(ids_of, find(t.as_py()))) for t in part.column("text")]
            # one buffer of all ids of the rows, cut by how many each has
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), tokens], schema=schema)

    return texts.mapInArrow(frugal(run), "doc_id long, ids binary, tokens array<int>")


def decoded(tokens: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that an array of ids stands for. An id without a token, or a null one, is an error; a null array gives null."""
    pieces: list[str | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.decode("latin-1")
    # bytes are written as Latin-1, so pieces join as strings, in one go
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    fault = F.raise_error(F.lit("an id has no token")).cast("string")
    joined = F.get(F.transform(F.array(table), lambda t: F.array_join(F.transform(tokens, lambda i: F.coalesce(F.get(t, i), fault)), "")), F.lit(0))
    return F.encode(joined, "ISO-8859-1")


def decode(encoded_rows: DataFrame, path: str) -> DataFrame:
    """encoded_rows (tokens: an array of ids) with bytes (binary), what the ids stand for. An id without a token is an error; null tokens stay
    null and none give no bytes. Repeated rows are decoded each, an empty table gives no rows, and a column named bytes is replaced."""
    return encoded_rows.withColumn("bytes", decoded(F.col("tokens"), load_ranks(path)))
