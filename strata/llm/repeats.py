"""Exact search for symbol strings of a fixed length that occur more than once in a corpus.

Symbols are bytes or words. A window is `length` consecutive symbols of one document. Comparing every window
with every other by a shuffle would move the corpus several hundred times, so windows are first grouped where they
lie: each window has a minimiser, the leftmost of its `gram`-symbol grams with the smallest hash, and neighbouring
windows with the same minimiser form one run ("super-k-mer"). Equal windows have equal minimisers at equal
places, so only runs with equal minimiser hashes can share windows:

* A run whose whole content occurs again is repeated in full. That is one group-by on (minimiser, content).
* Runs with a common minimiser and different contents - the edges of repeated passages - may share some windows.
  For them, one row for each different content is fetched from the text by its source coordinates, and
  `_resolve` sees all contents of a minimiser side by side.
* Where a minimiser has more than MOST contents - a passage that a share of all documents has, each with other text around it - one
  task can't hold them. There each run is cut into parts, by how far a window begins before the minimiser, and the symbols that all windows of
  a part have in common take the minimiser's place: they are longer, so fewer runs share them. The same steps follow with these, and
  parts that still meet too many others are cut again, down to single windows. A run is cut only where it is unlike others, so it
  gives few rows, and parts whose symbols no other has are done with.
* All other windows are unique.

A hash says which contents, or common symbols of very many contents, are equal (64 bits beside 64 of the minimiser); else windows of
different contents are compared symbol by symbol. Large groups of copies meet only in group-bys with partial
aggregation and in joins without a cap on either side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, materialize, row_key, text_or_empty

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Symbols handled at once; positions must fit the low bits of a sort key.
BLOCK_BITS = 20
BLOCK = 1 << (BLOCK_BITS - 1)
SPACES = b" \t\n\x0b\x0c\r"


@lru_cache(1)
def _byte_table() -> np.ndarray:
    return np.random.default_rng(20_240_613).integers(1, 1 << 64, 256, dtype=U) | U(1)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i below n at least."""
    size = max(1 << 20, 1 << (n - 1).bit_length()) + 4096
    if size not in _tables:
        _tables.clear()
        _tables[size] = tuple(np.concatenate([np.ones(1, U), np.multiply.accumulate(np.full(size - 1, b, U))]) for b in (BASE, INVERSE))
    return _tables[size]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(29))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    power, _ = _powers(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * power[: len(symbols)], out=sums[1:])
    return sums


def hashes(sums: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols at..end, the same wherever they lie."""
    _, inverse = _powers(len(sums))
    return (sums[end] - sums[at]) * inverse[at]


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _byte_table()[data]


def word_places(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the texts that lie one after another in data begin and end. Cuts: 0, inner borders, the end."""
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    blank = np.ones(len(data) + 1, bool)
    blank[:-1] = space[data]
    before = np.ones(len(data) + 1, bool)
    before[1:] = blank[:-1]
    inner = cuts[1:-1]
    begins, ends = ~blank & before, ~before & blank
    begins[inner], ends[inner] = ~blank[inner], ~before[inner]
    return np.flatnonzero(begins), np.flatnonzero(ends)


def word_symbols(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts that lie one after another in data, cut at cuts; and the cuts as numbers of words."""
    at, end = word_places(data, cuts)
    words = mix(hashes(prefix_sums(byte_symbols(data)), at, end) + (end - at).astype(U))
    return words, np.searchsorted(at, cuts)


def _long_word_symbols(data: np.ndarray) -> np.ndarray:
    """word_symbols of one long text, piece by piece."""
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        step = 4096
        while end < len(data) and not space[data[end]]:  # a piece ends at a space
            more = np.flatnonzero(space[data[end : end + step]])
            end = end + int(more[0]) if len(more) else min(len(data), end + step)
            step *= 2
        parts.append(word_symbols(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, U)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings or binaries and its offsets into them, without a copy."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array, unit: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first text, symbols, cuts, place of the first symbol in its text): texts together while they are short,
    a long one alone and in pieces whose last symbols the next piece repeats (OVERLAP)."""
    data, offsets = buffers(texts)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1
        if j > i:
            part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if unit == "byte":
                yield i, byte_symbols(part), cuts, 0
            else:
                yield i, *word_symbols(part, cuts), 0
            i = j
            continue
        part = data[offsets[i] : offsets[i + 1]]
        whole = part if unit == "byte" else _long_word_symbols(part)
        for at in range(0, len(whole), BLOCK):
            piece = whole[at : at + BLOCK + OVERLAP]
            yield i, byte_symbols(piece) if unit == "byte" else piece, np.array([0, len(piece)]), at
        i += 1


#: Symbols that pieces of a long text share; windows may have one more.
OVERLAP = 1023


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive keys: of prefix and suffix minima of blocks of that width."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(U).max, U)
    padded[: len(keys)] = keys
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(symbols: np.ndarray, cuts: np.ndarray, length: int, gram: int, limit: int | None = None):
    """Runs of windows with a common minimiser: text, place of the first window, number of windows, hash of
    the minimiser, hash of the content. Only windows that begin before limit count."""
    n = len(symbols)
    if n < length:
        return None
    lasts = n - length + 1
    sizes = np.diff(cuts)
    fits = np.flatnonzero(sizes >= length)
    steps = np.zeros(lasts + 1, np.int32)
    np.add.at(steps, cuts[fits], 1)
    np.add.at(steps, cuts[fits] + sizes[fits] - length + 1, -1)
    valid = np.cumsum(steps[:lasts]) > 0
    if limit is not None:
        valid[limit:] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return None
    sums = prefix_sums(symbols)
    _, inverse = _powers(len(sums))
    grams = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    low = U((1 << BLOCK_BITS) - 1)
    place = (window_minima((grams & ~low) | np.arange(len(grams), dtype=U), length - gram + 1) & low).astype(np.int64)[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    begin = at[first]
    text = np.searchsorted(cuts, begin, "right") - 1
    content = mix(hashes(sums, begin, begin + count + length - 1) ^ mix(count.astype(U)))
    return text, begin - cuts[text], count, grams[place[first]], content


def _find_runs(unit: str, length: int, gram: int) -> Callable:
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("mini", pa.int64()), ("content", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
            out = []
            for first, symbols, cuts, base in blocks(batch.column("text"), unit):
                got = runs(symbols, cuts, length, gram, BLOCK if len(cuts) == 2 and (base or len(symbols) > BLOCK) else None)
                if got:
                    text, at, count, mini, content = got
                    out.append((ids[first + text], keys[first + text], at + base, count.astype(np.int32), mini.view(np.int64), content.view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=schema)

    return frugal(find)


def _cut_out(unit: str, length: int, again: bool = False) -> Callable:
    """The symbols of the wanted runs of each text; or, again, of the wanted parts of each run that was cut out before."""
    schema = pa.schema([("mini", pa.int64()), ("root", pa.int64()), ("copies", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("symbols", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = []
                for i in range(part.num_rows):
                    data = np.frombuffer(part.column("symbols" if again else "text")[i].as_buffer(), np.uint8)
                    whole = data if unit == "byte" else data.view(U) if again else _long_word_symbols(data)
                    begin = part.column("of")[i].as_py() if again else 0
                    for x in part.column("wanted")[i].as_py():
                        content = whole[x["at"] - begin : x["at"] - begin + x["n"] + length - 1].tobytes()
                        out.append((x["mini"], x["root"], x["copies"], part.column("id")[i].as_py(), part.column("key")[i].as_py(), x["at"], x["n"], content))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return frugal(cut)


_CUT = "mini long, root long, copies long, id long, key long, at long, n int, symbols binary"


def ranks(symbols: np.ndarray, length: int) -> np.ndarray:
    """For each place, the rank of the next `length` symbols in suffix order, equal for equal strings. By prefix
    doubling: ranks by d symbols, taken twice, give ranks by up to 2 d. Past the end lie smallest symbols."""
    n = len(symbols)
    if symbols.dtype == np.uint8 and length >= 8:
        padded = np.concatenate([symbols, np.zeros(8, np.uint8)]).astype(U)
        key, depth = np.zeros(n, U), 8
        for i in range(8):
            key = (key << U(8)) | padded[i : i + n]
    else:
        key, depth = symbols, 1
    rank = np.unique(key, return_inverse=True)[1].astype(U) + U(1)
    while depth < length:
        step = min(depth, length - depth)
        after = np.zeros(n, U)
        after[: n - step] = rank[step:]
        rank = np.unique((rank << U(32)) | after, return_inverse=True)[1].astype(U) + U(1)
        depth += step
    return rank


def factors(rank: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the suffixes that begin at places (ascending), whether their longest previous factor, and their longest
    next one, has the length that rank goes by. In suffix order, with ties by place, the previous smaller
    place that shares so many symbols is the one just before, if its rank is equal; the next, the one just after."""
    order = np.argsort(rank[places], kind="stable")
    same = np.zeros(len(order) + 1, bool)
    sorted_ranks = rank[places][order]
    same[1:-1] = sorted_ranks[1:] == sorted_ranks[:-1]
    previous, following = np.empty(len(order), bool), np.empty(len(order), bool)
    previous[order], following[order] = same[:-1], same[1:]
    return previous, following


#: Contents of a minimiser that are compared in one task.
MOST = 1000
#: Parts that a run of all possible windows of a minimiser is cut into, if it has more contents; and each part, if it meets as many.
PARTS = 8


def _divide(unit: str, length: int, gram: int, width: int) -> Callable:
    """The parts of runs: windows that begin b * width up to (b + 1) * width - 1 symbols before the minimiser, root. mini becomes a hash of the old one, b and
    the symbols that all such windows share, so equal windows get equal ones; of is where the run begins."""
    names = ["mini", "content", "root", "copies", "id", "key", "of", "at", "n"]

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
            if not part.num_rows:
                continue
            data, cuts = buffers(part.column("symbols"))
            data, cuts = (byte_symbols(data), cuts) if unit == "byte" else (np.frombuffer(data.tobytes(), U), cuts // 8)
            sums = prefix_sums(data)
            n, root = part.column("n").to_numpy().astype(np.int64), part.column("root").to_numpy()
            # the minimiser is the first gram of that hash: an earlier one would be that of the first window
            grams = mix(hashes(sums, np.arange(len(data) - gram + 1), np.arange(gram, len(data) + 1)))
            places = np.flatnonzero(grams == np.repeat(root.view(U), np.diff(cuts))[: len(grams)])
            place = places[np.searchsorted(places, cuts[:-1])] - cuts[:-1]
            last, first = place // width, (place - n + 1) // width
            item = np.repeat(np.arange(len(n)), last - first + 1)
            before = (last[item] - (np.arange(len(item)) - np.searchsorted(item, item))) * width
            begin = np.maximum(place[item] - before - width + 1, 0)
            count = np.minimum(place[item] - before, n[item] - 1) - begin + 1
            at = cuts[item] + begin
            core = cuts[item] + place[item] - before
            shared = hashes(sums, core, core + length - width + 1)
            mini = mix(shared ^ mix(part.column("mini").to_numpy().view(U)[item] + before.astype(U)))
            content = mix(hashes(sums, at, at + count + length - 1) ^ mix(count.astype(U)))
            whole = {c: part.column(c).to_numpy()[item] for c in ("root", "copies", "id", "key", "at")}
            out = [mini.view(np.int64), content.view(np.int64), whole["root"], whole["copies"], whole["id"], whole["key"], whole["at"], whole["at"] + begin, count.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    return frugal(divide)


#: Bytes of symbols that are compared at once, but for a minimiser that has more. Arrays made on the way are about a hundred times as large.
TOGETHER = 1 << 18


def _resolve(unit: str, length: int, keep_first: bool, together: int = TOGETHER) -> Callable:
    """Decides each window of runs that share a minimiser with other contents. Rows come sorted by minimiser and
    by where they first occur."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("len", pa.int64())])
    kind = np.uint8 if unit == "byte" else U

    def solve(rows: pa.Table) -> pa.RecordBatch | None:
        rows = rows.combine_chunks()
        data, cuts = buffers(rows.column("symbols").chunk(0))
        data, cuts = (data, cuts) if unit == "byte" else (np.frombuffer(data.tobytes(), U), cuts // 8)
        n = rows.column("n").to_numpy()
        places = np.repeat(cuts[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item = np.repeat(np.arange(len(n)), n)
        # windows whose hash no other has are unique; only runs with others are put in suffix order
        window = hashes(prefix_sums(byte_symbols(data) if unit == "byte" else data), places, places + length)
        _, same, often = np.unique(window, return_inverse=True, return_counts=True)
        maybe = often[same] > 1
        if not maybe.any():
            return None
        del window, same, often
        places, item = places[maybe], item[maybe]
        wanted = np.unique(item)
        size = np.diff(cuts)
        moved = np.zeros(len(n), np.int64)
        moved[wanted] = cuts[wanted] - (np.cumsum(size[wanted]) - size[wanted])
        part = np.repeat(moved[wanted], size[wanted]) + np.arange(int(size[wanted].sum()))
        earlier, later = factors(ranks(data[part].astype(kind), length), places - moved[item])
        hit = earlier if keep_first else (earlier | later) & (rows.column("copies").to_numpy() == 1)[item]
        found = np.flatnonzero(hit)
        new = np.ones(len(found), bool)
        new[1:] = (places[found][1:] != places[found][:-1] + 1) | (item[found][1:] != item[found][:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(found)))
        at = found[first]
        which = item[at]
        where = rows.column("at").to_numpy()[which] + places[at] - cuts[which]
        names = [rows.column(c).to_numpy()[which] for c in ("id", "key")]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*names, where, (count + length - 1).astype(np.int64))], schema=schema)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows of whole minimisers: of several while they have at most `together` bytes, else of one."""
        held, size = [], 0  # rows to be given; the last minimiser's can go on in the next batch
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            minis = batch.column("mini").to_numpy()
            _, cuts = buffers(batch.column("symbols"))
            begins = np.append(np.flatnonzero(np.append(True, minis[1:] != minis[:-1])), batch.num_rows)
            lo = 0  # first row that isn't held yet
            for a, b in zip(begins, begins[1:]):
                bytes_ = int(cuts[b] - cuts[a])
                if minis[a] != last and size and size + bytes_ > together:
                    if a > lo:
                        held.append(batch.slice(lo, a - lo))
                    yield pa.Table.from_batches(held)
                    held, size, lo = [], 0, a
                size, last = size + bytes_, minis[a]
            held.append(batch.slice(lo))
        if held:
            yield pa.Table.from_batches(held)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (x for x in map(solve, groups(batches)) if x is not None)

    return frugal(resolve)


def repeated_spans(docs: DataFrame, unit: str, length: int, gram: int, keep_first: bool = False, most: int = MOST, whole_rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: doc_id, id, key, text of docs, null texts as empty, and with whole_rows no_text and the row but its text in a struct, rest. spans: id, key, at, len of symbols covered
    by windows that also begin elsewhere, or with keep_first by windows that begin earlier, in order of doc_id
    and place. Spans can overlap. id is doc_id, or the least number for null; rows with equal id and key are equal in id and text and share their spans.

    Tables that are joined to a hot minimiser's or content's rows are written first: Spark then splits such a key's rows over tasks."""
    if length > OVERLAP + 1 or gram > length:
        raise ValueError(f"windows of at most {OVERLAP + 1} symbols, grams of at most a window")
    text = text_or_empty()
    rest = [F.col("text").isNull().alias("no_text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")] if whole_rows else []
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("id"), row_key(F.col("doc_id"), text).alias("key"), text.alias("text"), *rest)
    runs_ = materialize(rows.select("id", "key", "text").mapInArrow(_find_runs(unit, length, gram), "id long, key long, at long, n int, mini long, content long"), "runs")
    again = materialize(runs_.groupBy("mini").count().where("count > 1").select("mini"), "minis")
    found = materialize(runs_.join(again, "mini", "left_semi"), "runs-again")
    discard(runs_, again)
    # a run is its own place in its text, and its minimiser its own root
    found = found.select("*", F.col("mini").alias("root"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("of"))
    spans, few, items, width = [], [], None, length - gram + 1
    while True:
        whole, contents, several = _compared(found, keep_first, most)
        spans.append(whole)

        def cut_out(which: str) -> DataFrame:
            chosen = contents.join(several.where(which).select("mini"), "mini", "left_semi")
            by = ["id", "key"] if items is None else ["id", "key", "of"]
            wanted = chosen.groupBy(*(f"first.{c}" for c in by)).agg(F.collect_list(F.struct("mini", "root", "copies", "first.at", "first.n")).alias("wanted"))
            if items is not None:
                return items.select("id", "key", F.col("at").alias("of"), "symbols").join(wanted, by).mapInArrow(_cut_out(unit, length, True), _CUT)
            if which == "many":  # of few texts: only these are shuffled once more
                wanted = materialize(wanted, "wanted")
                return _sieved(rows.select("id", "key", "text"), wanted).join(wanted, by).mapInArrow(_cut_out(unit, length), _CUT)
            # the same columns of rows as in what the caller joins to spans, so that texts are shuffled once for all
            return rows.join(wanted, by).select(*rows.columns, "wanted").mapInArrow(_cut_out(unit, length), _CUT)

        few.append(cut_out("not many"))
        if width == 1 or several.where("many").isEmpty():
            break
        # equal rows, of equal id and text, are cut out once each
        items = materialize(cut_out("many").dropDuplicates(["mini", "id", "key", "at"]), "items")
        width = -(-width // PARTS)
        found = materialize(items.mapInArrow(_divide(unit, length, gram, width), "mini long, content long, root long, copies long, id long, key long, of long, at long, n int"), "parts")
    few = reduce(DataFrame.unionByName, few).drop("root").repartition("mini").sortWithinPartitions("mini", "id", "key", "at")
    spans.append(few.mapInArrow(_resolve(unit, length, keep_first), "id long, key long, at long, len long"))
    spans = reduce(DataFrame.unionByName, (x if x is spans[-1] else x.select("id", "key", "at", (F.col("n") + length - 1).cast("long").alias("len")) for x in spans))
    return rows, spans


#: Words of 64 bits that tell which keys are wanted; they are broadcast, at most so many.
SIEVE = 1 << 20


def _sieved(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """All rows whose key is in wanted, and some others: those whose key has a bit in common with a wanted one. A join to wanted has to follow; it then
    shuffles these rows only. However many are wanted, the bits stay as many, and no wanted row is lost."""
    word, bit = F.pmod(F.shiftright("key", 6), F.lit(SIEVE)), F.expr("shiftleft(1L, cast(key & 63 as int))")
    bits = wanted.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return rows.join(F.broadcast(bits), word == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0).select(*rows.columns)


def _compared(found: DataFrame, keep_first: bool, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(whole, contents, several) of runs or parts of runs: those whose content is that of others; each content once; and the minimisers with
    several contents that aren't decided by that, many if one task can't hold them."""
    first = F.min(F.struct("id", "key", "at", "n", "of")).alias("first")
    contents = materialize(found.groupBy("mini", "content").agg(F.count(F.lit(1)).alias("places"), F.sum("copies").alias("copies"), F.min("root").alias("root"), first), "contents")
    whole = found.drop("copies", "root").join(contents.where("places > 1").select("mini", "content", "first"), ["mini", "content"])
    if keep_first:
        whole = whole.where("id <> first.id or key <> first.key or at <> first.at")
    several = contents.groupBy("mini").agg(F.count(F.lit(1)).alias("contents"), F.min("copies").alias("fewest"))
    several = several.where("contents > 1" if keep_first else "contents > 1 and fewest = 1").select("mini", (F.col("contents") > most).alias("many"))
    return whole, contents, materialize(several, "several")


def merged_spans(spans: pa.ListScalar) -> list[tuple[int, int]]:
    """Maximal runs (begin, end) of overlapping or touching spans (at, len). A row can have a span for each of its windows, so they stay in arrays."""
    if not spans.is_valid or not len(spans.values):
        return []
    at, size = (x.to_numpy() for x in spans.values.flatten())
    order = np.argsort(at, kind="stable")
    at, reach = at[order], np.maximum.accumulate((at + size)[order])
    new = np.flatnonzero(at[1:] > reach[:-1])
    return list(zip(at[np.append(0, new + 1)].tolist(), reach[np.append(new, len(at) - 1)].tolist(), strict=True))


def in_parts(rows: Iterator[tuple], sizes: Callable[[tuple], int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of PART rows at most, and fewer where they are large: a batch ends once it has PART_BYTES."""

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sizes(row)
        if len(held) == PART or size >= PART_BYTES:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


#: Rows, and bytes of their kept texts, that are given at once.
PART, PART_BYTES = 256, 1 << 22


def rows_with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows and a column spans, null where there are none."""
    by_row = spans.groupBy("id", "key").agg(F.collect_list(F.struct("at", "len")).alias("spans"))
    return rows.join(by_row, ["id", "key"], "left")
