"""Near duplicates by weighted Jaccard similarity of word shingles, found with BagMinHash signatures.

A text is the multiset of its five-word shingles. BagMinHash (Ertl, 2018) gives each (shingle, weight) the points of a
Poisson process over time, weight and signature component; a text with weight w of a shingle has the points below w,
and a component's value is the earliest time it gets. Two texts agree in a component with probability sum(min) / sum(max), exactly
their weighted Jaccard similarity. The weight axis is discretised hierarchically: [0, 1), [1, 2), [2, 4), [4, 8) ...; each shell
is a process of its own with rate in proportion to its width, so a shingle of weight w costs log2 w processes, and in the last shell
points at or above w are passed over. A process is followed only until its time passes the largest value in the signature so far.

Equal texts are first collapsed to one node, known by 64 bits, and by 64 more where those meet. Nodes with equal bands of the signature share a bucket, whose smallest node is its pivot.
Pairs are compared by exact multiset overlap.

1. Each node is compared with the smallest of its pivots whose signature is like its own: one pair a node, which settles groups of near
   copies as a star. Then with its other such pivots, and with the one other node of a bucket of two, where components differ.
2. Of larger buckets that still hold several components, nodes leave of which too many shingles occur in no other text there: they can't have a link.
3. In what is left, every pair of a bucket is decided exactly in one product of shingle matrices, block by block where a bucket is large, and of the
   links found those are given that join components. No pair is written out.

So every pair of texts that shares a bucket is in one component or was found not to be similar enough; nothing is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, materialize, row_key, text_or_empty, unused
from .repeats import BLOCK, U, buffers, hashes, mix, prefix_sums, word_symbols, _long_word_symbols

SHINGLE = 5
BANDS, ROWS = 24, 5
#: A pair is linked from this similarity on, as a fraction.
LEAST = (4, 5)
#: Members of a bucket that one task compares with a pivot.
STAR = 500


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their counts. Fewer words than a shingle make one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.arange(max(1, n - SHINGLE + 1))
    sums = prefix_sums(words)
    return np.unique(mix(hashes(sums, at, np.minimum(at + SHINGLE, n)) + U(min(n, SHINGLE))), return_counts=True)


def text_words(data: np.ndarray) -> np.ndarray:
    return word_symbols(data, np.array([0, len(data)]))[0] if len(data) <= BLOCK else _long_word_symbols(data)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """One row of m times for each bag of (hashes, weights); infinite where a bag is empty."""
    sizes = [len(h) for h, _ in bags]
    sign = np.full((len(bags), m), np.inf)
    if not sum(sizes):
        return sign
    bag = np.repeat(np.arange(len(bags)), sizes)
    item = np.concatenate([h for h, _ in bags])
    weight = np.concatenate([w for _, w in bags]).astype(np.float64)
    # shells of the weight axis: 0 is [0, 1), j is [2 ** (j - 1), 2 ** j)
    bags_, seeds, low, width, top = [], [], [], [], []
    shell = 0
    while len(item):
        lo = 0.0 if shell == 0 else 2.0 ** (shell - 1)
        bags_.append(bag)
        seeds.append(mix(item + U(0xD1B54A32D192ED03 * (shell + 1) & 0xFFFFFFFFFFFFFFFF)))
        low.append(np.full(len(item), lo))
        width.append(np.full(len(item), 1.0 if shell == 0 else lo))
        top.append(weight)
        shell += 1
        more = weight > 2.0 ** (shell - 1)
        bag, item, weight = bag[more], item[more], weight[more]
    bag, seed, low, width, top = map(np.concatenate, (bags_, seeds, low, width, top))
    time, step, flat = np.zeros(len(bag)), np.zeros(len(bag), U), sign.reshape(-1)
    while len(bag):
        draws = 1 if len(bag) > 50_000 else 8
        number = step[:, None] + np.arange(1, draws + 1, dtype=U)[None, :]
        first = mix(seed[:, None] + number * U(0x9E3779B97F4A7C15))
        second = mix(first ^ U(0xA0761D6478BD642F))
        times = time[:, None] + np.cumsum(-np.log(((first >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None], axis=1)
        component = ((second & U(0xFFFFFFFF)) * U(m)) >> U(32)
        inside = low[:, None] + width[:, None] * ((second >> U(32)).astype(np.float64) * 2.0**-32) < top[:, None]
        np.minimum.at(flat, (bag[:, None] * m + component.astype(np.int64))[inside], times[inside])
        time, step = times[:, -1], number[:, -1]
        on = time <= sign.max(axis=1)[bag]
        bag, seed, low, width, top, time, step = (x[on] for x in (bag, seed, low, width, top, time, step))
    return sign


def band_hashes(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sign[:, : bands * rows].view(U).reshape(len(sign), bands, rows)
    h = np.tile(np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15), (len(sign), 1))
    for i in range(rows):
        h = mix(h ^ parts[:, :, i]) + U(i)
    return h


_SIGNED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("size", pa.int64()), ("buckets", pa.list_(pa.int64())), ("sign", pa.binary())])
_SIGNED_DDL = "doc_id long, key long, node long, check long, size long, buckets array<long>, sign binary"


def _sign(bands: int, rows: int):
    """Signs each text once a batch: copies that come later in it have their size only, so that a group of copies doesn't meet in its buckets."""

    def signed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes, band hashes and short signatures of some texts."""
        data, cuts = buffers(texts)
        bags, i = [], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + BLOCK, "right")) - 1)
            if j == i + 1:
                bags.append(shingles(text_words(data[cuts[i] : cuts[j]])))
            else:
                words, at = word_symbols(data[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i])
                bags += [shingles(words[a:b]) for a, b in zip(at, at[1:])]
            i = j
        times = signatures(bags, bands * rows)
        return np.array([int(w.sum()) for _, w in bags], np.int64), band_hashes(times, bands, rows).view(np.int64), (mix(times.view(U)) & U(0xFFFF)).astype("<u2")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.column_stack([batch.column(c).to_numpy() for c in ("node", "check")])
            _, own, text = np.unique(names, axis=0, return_index=True, return_inverse=True)
            text = own[text.ravel()]
            own.sort()
            sizes = np.zeros(batch.num_rows, np.int64)
            cuts = buffers(batch.column("text"))[1]
            length = np.cumsum(np.diff(cuts)[own])
            lo = 0
            while lo < len(own):  # texts of about four blocks, then all rows up to the next such text
                hi = max(lo + 1, int(np.searchsorted(length, (length[lo - 1] if lo else 0) + 4 * BLOCK, "right")))
                first, end = int(own[lo]), int(own[hi]) if hi < len(own) else batch.num_rows
                some = own[lo:hi]
                sizes[some], h, short = signed(batch.column("text").take(pa.array(some)))
                n = end - first
                full = np.zeros(n, np.int32)
                full[some - first] = np.where(sizes[some] > 0, bands, 0)
                signs = np.full(n, None, object)
                signs[some - first] = [x.tobytes() for x in short]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full)]).astype(np.int32)), pa.array(h[sizes[some] > 0].ravel()))
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in _SIGNED.names[:4]), pa.array(sizes[text[first:end]]), lists, pa.array(signs, pa.binary())], schema=_SIGNED)
                lo = hi

    return frugal(sign)


def _apart(signed: DataFrame) -> DataFrame:
    """Texts whose first 64 bits are equal and whose other 64 bits aren't get nodes of their own."""
    twins = signed.groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("most")).where("least <> most").select("node", "least")
    twins = materialize(twins, "twins")
    if twins.isEmpty():
        discard(twins)
        return signed
    node = F.when(F.col("check") == F.coalesce("least", "check"), F.col("node")).otherwise(F.xxhash64("node", "check"))
    return signed.join(twins, "node", "left").withColumn("node", node).drop("least")


def _verify(num: int, den: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, centre = None, None
        for batch in batches:
            pivots, salts, roles, nodes = (batch.column(c).to_numpy() for c in ("pivot", "salt", "role", "node"))
            data, cuts = buffers(batch.column("text"))
            out = []
            for i in range(batch.num_rows):
                h, w = shingles(text_words(data[cuts[i] : cuts[i + 1]]))
                if roles[i] == 0:
                    star, centre = (pivots[i], salts[i]), (h, w)
                    continue
                if star != (pivots[i], salts[i]):
                    raise ValueError("a pivot's text is missing")
                _, a, b = np.intersect1d(centre[0], h, assume_unique=True, return_indices=True)
                both = int(np.minimum(centre[1][a], w[b]).sum())
                if den * both >= num * (int(centre[1].sum()) + int(w.sum()) - both):
                    out.append((int(pivots[i]), int(nodes[i])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)

    return frugal(verify)


def _links(pairs: DataFrame, texts: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs (pivot, node) that are similar enough. A pivot with many nodes is spread over salted stars, each with its text."""
    stars = pairs.groupBy("pivot").count().withColumn("salts", F.ceil(F.col("count") / STAR).cast("int"))
    arms = pairs.join(stars, "pivot").select("node", "pivot", F.expr("cast(pmod(xxhash64(node), salts) as int)").alias("salt"), F.lit(1).alias("role"))
    hubs = arms.select("pivot", "salt").distinct().select(F.col("pivot").alias("node"), "pivot", "salt", F.lit(0).alias("role"))
    sent = texts.join(arms.unionByName(hubs), "node").select("pivot", "salt", "role", "node", "text")
    return sent.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role").mapInArrow(_verify(*least), "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node of links (u, v), which can repeat or join a node to itself. No links give no rows.

    Alternating large and small stars (Kiveris et al., 2014), however many links there are; each step is written out and nothing is
    gathered in one place.
    """
    links = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        before, links = links, materialize(small.distinct(), "links")
        discard(before)
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


#: Nodes of a block; a bucket of more is compared block by block.
BLOCK_NODES = 512
#: A node and a pivot whose signatures agree in a smaller share of components below the least similarity aren't compared as a star.
SLACK = 0.2


def _possible(least: tuple[int, int]) -> Column:
    """Whether the sizes of two texts leave it open that they are similar enough: exact."""
    num, den = least
    return F.expr(f"{den} * least(size, other_size) >= {num} * greatest(size, other_size)")


def _likely(m: int, least: tuple[int, int]) -> Column:
    """Whether the signatures of two texts (16 bits a component) agree about as often as those of similar ones do. It only says which pairs are
    compared as stars; the others are decided with the rest of their bucket."""
    num, den = least
    agree = f"size(filter(sequence(1, {2 * m - 1}, 2), i -> substring(sign, i, 2) = substring(other_sign, i, 2)))"
    return F.expr(f"{agree} >= {m * (num / den - SLACK)}")


def _open(rows: DataFrame) -> DataFrame:
    """Buckets that hold several components, one of those with the same nodes."""
    found = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("root").alias("r"), F.max("root").alias("s"), F.min("node").alias("a"), F.max("node").alias("b"), F.bit_xor(F.xxhash64("node")).alias("nodes")
    )
    return found.where("r <> s").groupBy("n", "a", "b", "nodes").agg(F.min("bucket").alias("bucket"))


def similar_pairs(bags: list[tuple[np.ndarray, np.ndarray]], num: int, den: int, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of bags whose weighted Jaccard similarity is num / den or more. The k-th copy of a shingle is an item of its own, so
    an overlap is a count of common items: a product of 0-1 matrices, made for some thousand items at a time."""
    n = len(bags)
    rows = np.repeat(np.arange(n), [int(w.sum()) for _, w in bags])
    items = [np.repeat(h, w) + U(0x9E3779B97F4A7C15) * (np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)).astype(U) for h, w in bags]
    _, item, often = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    common = often[item] > 1
    rows, item = rows[common], np.unique(item[common], return_inverse=True)[1]
    order = np.argsort(item, kind="stable")
    rows, item = rows[order], item[order]
    overlap = np.zeros((n, n), np.float32)
    for lo in range(0, int(item[-1]) + 1 if len(item) else 0, chunk):
        a, b = np.searchsorted(item, [lo, lo + chunk])
        x = np.zeros((n, chunk), np.float32)
        x[rows[a:b], item[a:b] - lo] = 1
        overlap += x @ x.T
    size = np.array([int(w.sum()) for _, w in bags], np.float64)
    return np.nonzero(np.triu((den * overlap >= num * (size[:, None] + size[None, :] - overlap)) & (overlap > 0), 1))


def _within(num: int, den: int):
    """Links between components, within buckets or pairs of their blocks. Of links that join the same components one is given."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        parent = {r[1]: r[1] for r in rows}
        if len(parent) < 2:
            return []

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for i, j in zip(*similar_pairs([shingles(text_words(np.frombuffer(r[2], np.uint8))) for r in rows], num, den), strict=True):
            a, b = find(rows[i][1]), find(rows[j][1])
            if a != b:
                parent[b] = a
                out.append((rows[i][0], rows[j][0]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            texts = batch.column("text")
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "x", "y", "node", "root")), strict=True)):
                if row[:3] != key:
                    out += solve(held)
                    key, held = row[:3], []
                held.append((row[3], row[4], texts[i].as_buffer().to_pybytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)
                out = []
        out += solve(held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)

    return frugal(run)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("node", pa.int64()), ("shingle", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        data, cuts = buffers(batch.column("text"))
        nodes = batch.column("node").to_numpy()
        for i in range(batch.num_rows):
            h, w = shingles(text_words(data[cuts[i] : cuts[i + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), nodes[i])), pa.array(h.view(np.int64)), pa.array(w)], schema=schema)


def _able(nodes: DataFrame, texts: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Those of the nodes that can be similar enough to another one. A shingle that no other of them has is in no overlap, so a
    text can reach at most the share of its other shingles. Exact: it settles groups of variants that each differ from all others
    by a little too much, of which no pair is a link and every pair looks like one."""
    num, den = least
    counted = texts.join(nodes.select("node"), "node", "left_semi").mapInArrow(frugal(_counted), "node long, shingle long, n long")
    own = counted.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts"), F.min("node").alias("node"), F.min("n").alias("n")).where("texts = 1")
    own = own.groupBy("node").agg(F.sum("n").alias("own"))
    return nodes.join(own, "node", "left").where(f"{den} * (size - coalesce(own, 0)) >= {num} * size").select("node")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that aren't in one component yet."""
    a = roots.select("node", F.col("root").alias("a"))
    b = roots.select(F.col("node").alias("pivot"), F.col("root").alias("b"))
    return pairs.join(a, "node", "left").join(b, "pivot", "left").where("coalesce(a, node) <> coalesce(b, pivot)").select("node", "pivot")


def classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row for each row of docs: doc_id, key (names rows of equal id and text), node (equal for equal texts), class_node (equal within
    a class of near duplicates), class_id (the smallest doc_id of the class), n_shingles.

    Texts whose weighted Jaccard similarity of five-word shingles is `least` or more are linked, found with
    probability 1 - (1 - s ** rows) ** bands for similarity s: 0.99993 at 0.8. Classes are connected by links. A null text
    counts as empty. Equal texts are always in one class; texts without a word have no other links, texts of fewer than five words
    have one shingle. A class_id is null only if all doc_ids of the class are. An empty table gives no rows. Other columns are ignored.
    """
    text, identity = text_or_empty(), F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("id")
    source = docs.select("doc_id", row_key(F.col("doc_id"), text).alias("key"), F.xxhash64(F.length(text), text).alias("node"), F.xxhash64(text, F.lit("check")).alias("check"), text.alias("text"))
    written = materialize(source.mapInArrow(_sign(bands, rows), _SIGNED_DDL), "signed")
    signed = _apart(written)
    spread = signed.select("node", F.explode("buckets").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last").select("bucket", "pivot")
    members = materialize(spread.join(shared, "bucket").select("bucket", "node", "pivot").distinct(), "members")
    # one row of each node that shares a bucket: which row has its text, its size and its signature
    nodes = signed.join(members.select("node").distinct(), "node", "left_semi").groupBy("node")
    nodes = nodes.agg(F.min(F.struct(identity, "key")).alias("row"), F.first("size").alias("size"), F.first("sign", ignorenulls=True).alias("sign"))
    nodes = materialize(nodes.select("node", "row.id", "row.key", "size", "sign"), "nodes")
    # a merge at every size: a small corpus then shows the costs that a large one has, whose nodes can't be broadcast
    wanted = nodes.select("node", "id", "key").hint("merge")
    texts = materialize(source.select(identity, "key", "text").join(wanted, ["id", "key"]).select("node", "text"), "texts")
    about = nodes.select("node", "size", "sign")
    pivots = about.select(F.col("node").alias("pivot"), F.col("size").alias("other_size"), F.col("sign").alias("other_sign"))
    likely = _likely(bands * rows, least).alias("likely")

    stars = members.where("node <> pivot").select("node", "pivot").distinct().join(about, "node").join(pivots, "pivot").where(_possible(least))
    pairs = materialize(stars.select("node", "pivot", likely), "stars")
    stars = pairs.where("likely").drop("likely")
    first = stars.groupBy("node").agg(F.min("pivot").alias("pivot"))
    found = materialize(_links(first, texts, least), "found")
    roots = components(found)

    now = members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    # a bucket of two is a pair with its pivot and is compared as such, likely or not; larger ones are decided as a whole
    open_ = materialize(_open(now), "buckets")
    twos = open_.where("n = 2").select(F.col("b").alias("node"), F.col("a").alias("pivot"))
    unlikely = pairs.where("not likely").select("node", "pivot").join(twos, ["node", "pivot"], "left_semi")
    rest = materialize(_across(stars.join(first, ["node", "pivot"], "left_anti"), roots).unionByName(unlikely), "pairs")
    opened = materialize(now.join(open_.where("n > 2").select("bucket"), "bucket"), "open")
    able = _able(opened.select("node").distinct().join(about, "node").select("node", "size"), texts, least)
    rows_ = able_rows = materialize(opened.join(able, "node", "left_semi"), "able")
    # a pivot can leave, and a pair with a pivot that stays can be an unlikely one, so buckets of two count here
    left = _open(rows_).withColumn("blocks", F.ceil(F.col("n") / BLOCK_NODES).cast("int"))
    rows_ = rows_.join(left.select("bucket", "blocks"), "bucket").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    rows_ = rows_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows_ = rows_.select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "node", "root").join(texts, "node")
    within = rows_.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "node").mapInArrow(_within(*least), "u long, v long")
    more = materialize(within.unionByName(_links(rest, texts, least)), "found")
    if not more.isEmpty():
        roots = components(found.unionByName(more))
    discard(members, nodes, texts, pairs, found, open_, rest, opened, able_rows, more)
    # a table of nodes and one of classes, written first: what joins to a hot one is then split over tasks
    named = signed.groupBy("node").agg(F.min("doc_id").alias("id")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("class_node"), "id")
    named = materialize(named, "node-classes")
    ids = materialize(named.groupBy("class_node").agg(F.min("id").alias("class_id")), "class-ids")
    placed = materialize(named.select("node", "class_node").join(ids, "class_node"), "classes")
    discard(named, ids)
    return signed.join(placed, "node").select("doc_id", "key", "node", "class_node", "class_id", F.col("size").alias("n_shingles"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that come first in their class: smallest doc_id, and of rows equal in id and text one. An
    empty table gives no rows."""
    text, key = text_or_empty(), unused("key", docs.columns)
    found = classes(docs)
    # nulls sort last, so that a class keeps a row with an id if it has one
    first = found.groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")).alias("first"))
    first = first.select(F.col("first.key").alias(key), F.col("first.doc_id").alias(f"{key}_id"))
    kept = docs.withColumn(key, row_key(F.col("doc_id"), text))
    kept = kept.join(first, (kept[key] == first[key]) & kept["doc_id"].eqNullSafe(first[f"{key}_id"]), "left_semi")
    return kept.dropDuplicates([key, "doc_id"]).select(*(f"`{c}`" for c in docs.columns))
