"""SimHash near-duplicates: fingerprints, a byte-position inverted index with count filtering,
and components.

**Fingerprints.** The text is lower-cased (A to Z), cut into words and 4-word shingles; a bit of
the 64-bit fingerprint is 1 if it is set in over half of the shingles' XXH64 values. The hashes
are computed for a whole batch of texts at once, over unaligned 8-byte reads of one buffer.

**Links.** Fingerprints that differ in at most 4 bits differ in at most 4 of their 8 bytes, so they
share at least 4 bytes in the same positions: the guaranteed minimum. Posting lists are keyed by
four positions and the bytes there: 32 fixed bits keep lists short at any input size, where lists
by a single byte would hold 1/256 of all fingerprints each, and every pair that reaches the minimum
meets in a list. Every distinct fingerprint has 70 postings, made and ordered by built-in functions;
lists of a single fingerprint end there. Within a list the equal bytes of each pair are tallied,
pairs that reach the minimum are verified by their differing bits, and only a spanning forest of
the links leaves the task.

**Dense lists.** A list of over ``LIST_LIMIT`` fingerprints (one passage with endless variations)
isn't compared pair by pair. Its members are linked by midpoints: two fingerprints differ in at
most 4 bits just if some value differs from each in at most 2, so everyone posts the 2081 values
within 2 bits, and all who meet at a value are truly linked. That is exact and linear too.

**Components.** Labels spread along the links with pointer jumping; each round is written to the
shared folder. Only distinct fingerprints and links take part; copies join at the end by their
fingerprint, the most frequent ones by broadcast. No fingerprint, link or component reaches the driver, only counts do.

Null and empty texts, and texts without words, have fingerprint zero and link like any other.
Rows with a repeated doc_id are separate members; rows with a null doc_id are fingerprinted, and
count as members, but can't name a component: it is null if no member has an id. Further columns
have no effect; ``keep_first`` carries them along. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HELPER, gathered, map_arrow, stored, text_bytes, text_hash

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Fingerprints of one posting list that are still compared pair by pair: as many as a
#: fingerprint has midpoints, so that neither way costs much more than the other.
LIST_LIMIT = 2048

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (
        0x9E3779B185EBCA87,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5,
    )
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_spans(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of ``data[start:end]`` for many spans. Spans of 32 bytes or more go to the library."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    words = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
    halves = np.ndarray((len(padded) - 3,), "<u4", buffer=padded, strides=(1,))
    size = ends - starts
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(size >= 32)
    digest = xxhash.xxh64_intdigest
    out[long] = [digest(data[i:j], seed) for i, j in zip(starts[long].tolist(), ends[long].tolist())]
    short = np.flatnonzero(size < 32)
    at, left = starts[short].copy(), size[short].copy()
    h = np.uint64(seed) + _P5 + left.astype(np.uint64)
    for _ in range(3):
        k = np.flatnonzero(left >= 8)
        lane = _rotl(words[at[k]] * _P2, 31) * _P1
        h[k] = _rotl(h[k] ^ lane, 27) * _P1 + _P4
        at[k] += 8
        left[k] -= 8
    k = np.flatnonzero(left >= 4)
    h[k] = _rotl(h[k] ^ (halves[at[k]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at[k] += 4
    left[k] -= 4
    for _ in range(3):
        k = np.flatnonzero(left > 0)
        h[k] = _rotl(h[k] ^ (padded[at[k]].astype(np.uint64) * _P5), 11) * _P1
        at[k] += 1
        left[k] -= 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    out[short] = h ^ (h >> np.uint64(32))
    return out


#: Bytes of normalised text that are hashed at once.
_BLOCK = 1 << 19


def simhash(texts: list[bytes], shingle: int = SHINGLE, distinct: bool = False, seed: int = SEED) -> np.ndarray:
    """The fingerprints (uint64) of UTF-8 texts; with ``distinct``, repeated shingles count once."""
    out = np.zeros(len(texts), np.uint64)
    block: list[tuple[int, bytes]] = []
    size = 0
    for k, text in enumerate(texts):
        words = text.lower().split()
        if words:
            block.append((k, b" ".join(words)))
            size += len(block[-1][1]) + 1
        if size >= _BLOCK:
            _simhash_block(block, out, shingle, distinct, seed)
            block, size = [], 0
    _simhash_block(block, out, shingle, distinct, seed)
    return out


def _shingle_hashes(block: list[bytes], shingle: int, seed: int = SEED) -> tuple[np.ndarray, list[int]]:
    """The hashes of all shingles of texts whose words are space-joined, and each text's number."""
    data = b" ".join(block) + b" "
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    begins = np.concatenate(([0], spaces[:-1] + 1))
    # Words of each text, by the place of its last space.
    last = np.cumsum([len(text) + 1 for text in block]) - 1
    upto = np.searchsorted(spaces, last) + 1
    n_words = np.diff(upto, prepend=0)
    n_shingles = np.maximum(n_words - shingle + 1, 1)
    first = np.repeat(upto - n_words, n_shingles)
    offset = np.arange(n_shingles.sum()) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    span = np.repeat(np.minimum(n_words, shingle), n_shingles)
    begin = first + offset
    return xxh64_spans(data, begins[begin], spaces[begin + span - 1], seed), n_shingles.tolist()


def _simhash_block(block: list[tuple[int, bytes]], out: np.ndarray, shingle: int, distinct: bool, seed: int) -> None:
    if not block:
        return
    hashes, numbers = _shingle_hashes([text for _, text in block], shingle, seed)
    at = 0
    place = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for (k, _), n in zip(block, numbers):
        one = hashes[at : at + n]
        at += n
        if distinct:
            one = np.unique(one)
            n = len(one)
        set_bits = np.zeros(64, np.int64)
        for i in range(0, n, 1 << 16):
            part = one[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.bitwise_or.reduce(place[2 * set_bits > n], initial=np.uint64(0))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp``: a row for each document; ``fp`` has the fingerprint's bits as a
    long, and ``text_hash`` tells texts of one doc_id from each other."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def compute(batches):
        for batch in batches:
            fp = simhash(text_bytes(batch.column(2))).view(np.int64)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "text_hash": batch.column(1), "fp": pa.array(fp)}
            )

    rows = docs.select("doc_id", text_hash().alias("text_hash"), "text")
    return map_arrow(rows, compute, f"doc_id {id_type}, text_hash long, fp long")


_BYTES = np.array([0xFF << (8 * k) for k in range(8)], np.uint64)
#: Bytes that fingerprints within ``MAX_BITS`` share at least, in the same positions.
SHARED = 8 - MAX_BITS


def masks(shared: int) -> list[int]:
    """For each choice of ``shared`` byte positions, the mask of those bytes, as a long."""
    return [int(np.bitwise_or.reduce(_BYTES[list(c)]).view(np.int64)) for c in combinations(range(8), shared)]


def postings(rows: DataFrame, shared: int = SHARED) -> DataFrame:
    """``quad, bytes`` and the columns of ``rows``: what the inverted index holds of each row's
    fingerprint ``fp``, by ``shared`` positions; ``quad`` numbers the choice of them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(mask)) for mask in masks(shared)))
    return rows.repartition(n, "fp").select(F.posexplode(keys).alias("quad", "bytes"), *rows.columns)


def shared_lists(index: DataFrame) -> DataFrame:
    """The postings of lists with two members or more, list by list in each partition."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = Window.partitionBy("quad", "bytes").orderBy(*index.columns[2:])
    near = index.repartition(n, "quad", "bytes").select(
        "*", F.lag("fp").over(own).alias("before"), F.lead("fp").over(own).alias("after")
    )
    kept = near.filter("before is not null or after is not null")
    return kept.select(index.columns).sortWithinPartitions(*index.columns)


def _equal_bytes(differ: np.ndarray) -> np.ndarray:
    """How many of the 8 bytes are zero in each of ``differ``."""
    return (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def spanning_links(fps: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """Links that connect whatever links of at most ``MAX_BITS`` connect among ``fps``, and how many
    pairs were verified: those whose tally of equal bytes reaches ``SHARED``."""
    bits, root = fps.view(np.uint64), np.arange(len(fps))
    out, verified = [], 0
    for k in range(len(fps) - 1):
        differ = bits[k + 1 :] ^ bits[k]
        near = np.flatnonzero(_equal_bytes(differ) >= SHARED)
        verified += len(near)
        near = near[np.bitwise_count(differ[near]) <= MAX_BITS] + k + 1
        while len(near := near[root[near] != root[k]]):
            out.append((int(fps[k]), int(fps[near[0]])))
            root[root == root[near[0]]] = root[k]
    return out, verified


def list_links(index: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """``a, b`` for links inside posting lists; ``b`` is null where ``a`` is of a dense list.

    A task reads its lists in order and holds ``limit`` fingerprints at most.
    """

    def link(batches):
        key, held, dense = None, [], False
        left: list[int] = []
        right: list[int | None] = []

        def close() -> None:
            if not dense and len(held) > 1:
                for a, b in spanning_links(np.array(held, np.int64))[0]:
                    left.append(a)
                    right.append(b)

        def flush():
            columns = {"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())}
            left.clear()
            right.clear()
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            quad, kept, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero((quad[1:] != quad[:-1]) | (kept[1:] != kept[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(fp)]
            for i, j in zip(bounds, bounds[1:]):
                if (own := (quad[i], kept[i])) != key:
                    close()
                    key, held, dense = own, [], False
                if not dense and len(held) + j - i > limit:
                    left.extend(held)
                    right.extend([None] * len(held))
                    held, dense = [], True
                if dense:
                    left.extend(fp[i:j].tolist())
                    right.extend([None] * (j - i))
                else:
                    held.extend(fp[i:j].tolist())
            if len(left) >= 4096:
                yield flush()
        close()
        yield flush()

    return map_arrow(shared_lists(index), link, "a long, b long", 8192)


_ONE = [1 << k for k in range(64)]
#: All values with at most two bits set: from a fingerprint to its possible midpoints.
MIDPOINTS = np.array([0, *_ONE, *(a | b for a, b in combinations(_ONE, 2))], np.uint64)


def midpoint_links(dense: DataFrame) -> DataFrame:
    """``a, b`` linking everyone who meets at a midpoint to the least of them."""

    def post(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 64):  # 133,184 rows at most
                part = fp[i : i + 64]
                middle = (part.view(np.uint64)[:, None] ^ MIDPOINTS).reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"middle": pa.array(middle), "a": pa.array(np.repeat(part, len(MIDPOINTS)))}
                )

    posted = map_arrow(dense, post, "middle long, a long")
    least = posted.groupBy("middle").agg(F.min("a").alias("b"), F.max("a").alias("top"))
    met = least.filter("b <> top").select("middle", "b")
    return posted.join(met, "middle").filter("a <> b").select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, label``: for nodes that have links, the least ``node`` reachable along ``links``
    (``a, b``). Nodes without links are their own component and have no row.

    Each round takes the least label among a node and its neighbours, for the node and for the
    node that its label names, and then follows labels twice; rounds grow with the logarithm of a
    component's width.
    """
    both = stored(
        links.union(links.select("b", "a")).toDF("a", "b").filter("a <> b").distinct(), "links"
    )
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).toDF("node", "label")
    labels = stored(labels, "labels")
    while True:
        seen = both.join(labels.toDF("b", "seen"), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        offer = labels.join(seen.toDF("node", "seen"), "node")
        offer = offer.select("node", "label", F.least("label", "seen").alias("new"))
        # The node that a label names learns of the better label as well.
        hooks = offer.filter("new < label").groupBy(F.col("label").alias("node")).agg(F.min("new").alias("hook"))
        hooked = offer.join(hooks, "node", "left").select(
            "node", "label", F.least("new", F.coalesce("hook", "new")).alias("new")
        )
        hooked = stored(hooked, "hooked")
        up = hooked.select(F.col("node").alias("new"), F.col("new").alias("up"))
        jumped = hooked.join(up, "new", "left").select(
            "node", F.least("new", F.coalesce("up", "new")).alias("label"), F.col("label").alias("old")
        )
        jumped = stored(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("label <> old").isEmpty():
            return labels


def links_of(distinct: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints ``fp`` within ``MAX_BITS`` of each other."""
    found = stored(list_links(postings(distinct.select("fp")), limit), "lists")
    near = found.filter("b is not null")
    dense = found.filter("b is null").select("a").distinct()
    if dense.isEmpty():
        return near
    return near.union(midpoint_links(dense))


#: Fingerprints with over 1/HOT of all rows, of which there are at most HOT, are joined by broadcast.
HOT = 1000


def _members(docs: DataFrame, limit: int) -> DataFrame:
    """``doc_id, text_hash, fp, label, component_id`` of every row; ``label`` names the component by
    its least fingerprint."""
    rows = stored(fingerprints(docs), "fingerprints")
    groups = stored(
        rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "groups"
    )
    labels = components(links_of(groups, limit)).toDF("fp", "label")
    # From labels, which name fingerprints, to the least document of each component.
    named = groups.join(labels, "fp", "left").select("fp", "least", "n", F.coalesce("label", "fp").alias("label"))
    heads = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = stored(named.join(heads, "label").select("fp", "n", "label", "component_id"), "named")
    total = by_fp.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * HOT > F.lit(total)
    hot, rest = by_fp.filter(is_hot).drop("n"), by_fp.filter(~is_hot).drop("n")
    # No fingerprint that is joined by shuffle holds more than 1/HOT of the rows.
    frequent = rows.join(F.broadcast(hot), "fp")
    others = rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(rest, "fp")
    return frequent.unionByName(others)


def near_duplicates(docs: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    return _members(docs, limit).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The same columns, one row of each component: of the least doc_id, the text with the least
    hash. Rows that repeat doc_id and text are one; if other columns differ, the row with the least
    hash over all columns stays. Rows whose doc_id is null stay as they are."""
    members = _members(docs.filter("doc_id is not null"), limit)
    first = members.filter("doc_id = component_id").groupBy("doc_id", "label").agg(F.min("text_hash").alias("text_hash"))
    return _rows_of(docs, first.select("doc_id", "text_hash"))


def _rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id, text_hash`` are in ``kept``, each once, and those without
    doc_id."""
    kept = kept.toDF(HELPER + "_id", HELPER + "_kept")
    named = docs.select(text_hash().alias(HELPER), F.struct("*").alias(HELPER + "_row"))
    own = F.col(f"{HELPER}_row.doc_id")
    met = named.join(kept, (own == F.col(HELPER + "_id")) & (F.col(HELPER) == F.col(HELPER + "_kept")))
    order = F.xxhash64(*(F.col(f"{HELPER}_row.`{f.name}`") for f in docs.schema if "map" not in f.dataType.simpleString()))
    one = met.groupBy(HELPER + "_id", HELPER + "_kept").agg(F.min_by(HELPER + "_row", order).alias("row"))
    return one.select("row.*").unionByName(docs.filter("doc_id is null")).select(docs.columns)


#: Near copies share this much of their distinct shingles of so many words.
COPY_WORDS, SIMILARITY = 5, 0.8
#: Their candidates have two fingerprints of distinct shingles of so many words, by two seeds.
FEATURE_WORDS, COPY_SEEDS = 2, (42, 43)
#: One of the two shares so many bytes in the same positions and differs in so many bits at most,
#: the other in so many.
COPY_SHARED, COPY_BITS, OTHER_BITS = 3, 12, 16
#: Texts to verify that are looked up by broadcast, 16 bytes each, at most.
BROADCAST_TEXTS = 1_000_000


def _bits_apart(fp: np.ndarray, other: np.ndarray, fps: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many bits both fingerprints differ from ``fps`` and ``others``; 255 for no candidates."""
    differ = fp ^ fps
    own, more = np.bitwise_count(differ), np.bitwise_count(other ^ others)
    fits = (_equal_bytes(differ) >= COPY_SHARED) & (own <= COPY_BITS) & (more <= OTHER_BITS)
    return np.where(fits, own + more, 255)


def candidate_forest(fps: np.ndarray, others: np.ndarray) -> list[tuple[int, int]]:
    """Links, by place, that connect whatever the candidates among the members connect; near links
    come before far ones, so these are what is verified."""
    root, out = np.arange(len(fps)), []
    for step in (4, 12, 20, COPY_BITS + OTHER_BITS):
        for k in range(len(fps) - 1):
            if (root[k + 1 :] == root[k]).all():
                continue
            near = np.flatnonzero(_bits_apart(fps[k], others[k], fps[k + 1 :], others[k + 1 :]) <= step) + k + 1
            while len(near := near[root[near] != root[k]]):
                out.append((k, int(near[0])))
                root[root == root[near[0]]] = root[k]
        if (root == root[0]).all():
            break
    return out


def _links_in(lists: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """``a, b, quad, bytes, fp, other, block``: the links of each list (``keys, fp, other, norm``, in
    order), ``block`` being null; and the members ``a`` of lists of over ``limit``, in blocks of so
    many. A task holds ``limit`` members at most."""

    def link(batches):
        key, held, n, seen, dense = None, [], 0, 0, False
        links: list[np.ndarray] = []
        blocks: list[np.ndarray] = []

        def close() -> None:
            if not dense and n > 1:
                fps, others, norms = np.concatenate(held, axis=1)
                for a, b in candidate_forest(fps.view(np.uint64), others.view(np.uint64)):
                    links.append(norms[[a, b]][:, None])

        def flush():
            a, b = np.concatenate([np.empty((2, 0), np.int64), *links], axis=1)
            yield made([pa.array(a), pa.array(b), *[pa.nulls(len(a), pa.int64())] * 5])
            norms, *rest = np.concatenate([np.empty((6, 0), np.int64), *blocks], axis=1)
            yield made([pa.array(norms), pa.nulls(len(norms), pa.int64()), *map(pa.array, rest)])
            links.clear()
            blocks.clear()

        def made(columns: list[pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "quad", "bytes", "fp", "other", "block"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            own, rows = np.stack(columns[: len(keys)]), np.stack(columns[len(keys) :])
            cuts = np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1
            bounds = np.array([0, *cuts, batch.num_rows])
            # Lists of two that lie within the batch, all at once.
            pairs = np.flatnonzero(np.diff(bounds) == 2)
            pairs = bounds[pairs[(pairs > 0) & (pairs < len(bounds) - 2)]]
            first, second = rows[:, pairs], rows[:, pairs + 1]
            bits = [x.view(np.uint64) for x in (first[0], first[1], second[0], second[1])]
            near = _bits_apart(*bits) < 255
            links.append(np.stack([first[2, near], second[2, near]]))
            done = set(pairs.tolist())
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if i in done:
                    continue
                if (this := tuple(own[:, i].tolist())) != key:
                    close()
                    key, held, n, seen, dense = this, [], 0, 0, False
                held.append(rows[:, i:j])
                n += j - i
                dense = dense or n > limit
                if dense:
                    fps, others, norms = np.concatenate(held, axis=1)
                    place = (seen + np.arange(len(norms))) // limit
                    quad, kept = (np.full(len(norms), x) for x in key[:2])
                    blocks.append(np.stack([norms, quad, kept, fps, others, place]))
                    seen, held = seen + len(norms), []
            yield from flush()
        close()
        yield from flush()

    schema = "a long, b long, quad long, bytes long, fp long, other long, block long"
    return map_arrow(lists.select(*keys, "fp", "other", "norm"), link, schema, 8192)


def candidates(nodes: DataFrame, seed: int, limit: int = LIST_LIMIT) -> DataFrame:
    """``a, b``: links that connect the candidates among ``nodes`` (``norm, fps``) whose fingerprint
    of number ``seed`` meets in the index.

    Both fingerprints are compared in a list, so that members which share bytes by chance don't
    link, however large the input. Lists of over ``limit`` members are cut into blocks of so many,
    and each two blocks are compared in a task's turn: all pairs are, and none but links leave.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = nodes.select(F.col("fps")[seed].alias("fp"), F.col("fps")[1 - seed].alias("other"), "norm")
    found = gathered(_links_in(shared_lists(postings(own, COPY_SHARED)), ["quad", "bytes"], limit), "lists", "a")
    links = found.filter("block is null").select("a", "b")
    dense = found.filter("block is not null").drop("b").withColumnRenamed("a", "norm")
    if dense.isEmpty():
        return links
    last = dense.groupBy("quad", "bytes").agg(F.max("block").alias("last"))
    each = dense.join(last, ["quad", "bytes"]).withColumn("with", F.explode(F.sequence(F.lit(0), "last")))
    cells = each.select(
        "quad", "bytes", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "fp", "other", "norm"
    )
    keys = ["quad", "bytes", "low", "high"]
    dealt = cells.repartition(n, *keys).sortWithinPartitions(*keys, "fp", "norm")
    return links.union(gathered(_links_in(dealt, keys, 2 * limit), "cells", "a").select("a", "b"))


#: Bits of a set's signature, and counters of all sets' shingles: the latter only order them.
SIGNATURE_BITS, COUNTERS = 512, 1 << 18
#: Counters travel in so many parts.
_PARTS = 64


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``owner, shingle``: the distinct 5-word shingles of texts, as 64-bit hashes of their words'
    hashes, and the place of the text that has them. Fewer words are one shingle, none have none."""
    words = [b" ".join(text.lower().split()) for text in texts]
    full = [k for k, text in enumerate(words) if text]
    if not full:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    data = b" ".join(words[k] for k in full) + b" "
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    begins = np.concatenate(([0], spaces[:-1] + 1))
    each = xxh64_spans(data, begins, spaces)
    upto = np.searchsorted(spaces, np.cumsum([len(words[k]) + 1 for k in full]) - 1) + 1
    n_words = np.diff(upto, prepend=0)
    n_shingles = np.maximum(n_words - COPY_WORDS + 1, 1)
    offset = np.arange(n_shingles.sum()) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    begin = np.repeat(upto - n_words, n_shingles) + offset
    span = np.repeat(np.minimum(n_words, COPY_WORDS), n_shingles)
    h = span.astype(np.uint64) * _P5
    for k in range(COPY_WORDS):
        more = span > k if k else slice(None)
        h[more] = _rotl((h[more] ^ each[begin[more] + k]) * _P2, 31) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    owner = np.repeat(np.array(full), n_shingles)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def _text_blocks(texts: list[bytes]):
    """The texts in runs of about ``_BLOCK`` bytes, with the place of each run's first."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= _BLOCK or k == len(texts) - 1:
            yield at, texts[at : k + 1]
            at, size = k + 1, 0


def _counter(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _signatures(owner: np.ndarray, shingle: np.ndarray, n: int) -> list[bytes]:
    """Per text, which of ``SIGNATURE_BITS`` residues occur an odd number of times in its set. Two
    sets differ in at least as many shingles as their signatures in bits."""
    place = owner * SIGNATURE_BITS + (shingle % np.uint64(SIGNATURE_BITS)).astype(np.int64)
    odd = np.bincount(place, minlength=n * SIGNATURE_BITS).reshape(n, -1) & 1
    return [bytes(row) for row in np.packbits(odd.astype(np.uint8), axis=1)]


def shingle_counts(parts: DataFrame) -> np.ndarray:
    """The counters of all texts' shingles, summed from ``part, counts`` of each task."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(counts, "<i8")
                sums[part] = sums[part] + more if part in sums else more
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())}
        )

    out = np.zeros((_PARTS, COUNTERS // _PARTS), np.int64)
    for row in map_arrow(parts.select("part", "counts").repartition(n, "part"), add, "part int, counts binary").collect():
        out[row.part] = np.frombuffer(bytes(row.counts), "<i8")
    return out.reshape(-1)


def _needed(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles of a set of ``n`` any similar set holds at least; less where rounding could err."""
    return np.ceil(similarity * n - 1e-6).astype(np.int64)


def prefix_postings(docs: DataFrame, counts: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """``shingle, norm, n, place``: of each text the first shingles in an order that all texts
    share, rarely counted ones first: as many as must hold one in common with any similar set."""

    def post(batches):
        known: set[int] = set()
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for _, block in _text_blocks(texts):
                norms = [xxhash.xxh64_intdigest(b" ".join(t.lower().split())) for t in block]
                fresh = []
                for k, norm in enumerate(norms):
                    if norm not in known:
                        known.add(norm)
                        fresh.append(k)
                if len(known) > 100_000:  # copies are told apart later as well
                    known.clear()
                owner, h = shingle_sets([block[k] for k in fresh])
                order = np.lexsort((h, counts[_counter(h)], owner))
                owner, h = owner[order], h[order]
                n = np.bincount(owner, minlength=len(fresh))
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                keep = place <= np.repeat(n - _needed(n, similarity), n)
                owner = owner[keep]
                norm = np.array([norms[k] for k in fresh], np.uint64).view(np.int64)
                columns = (h[keep].view(np.int64), norm[owner], n[owner].astype(np.int32), place[keep].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["shingle", "norm", "n", "place"])

    return map_arrow(docs.select("text"), post, "shingle long, norm long, n int, place int")


def _possible(rows: list[np.ndarray], k: int, low: int, high: int, similarity: float) -> np.ndarray:
    """Which of the members ``low`` to ``high`` of a list may be similar to member ``k``, of another
    label: by sizes, by what is left behind the shared shingle, and by signatures."""
    label, norm, n, place, block, bits = rows
    both = n[k] + n[low:high]
    least = np.ceil(similarity / (1 + similarity) * both - 1e-6)
    most = np.minimum(n[k] - place[k], n[low:high] - place[low:high])
    near = np.flatnonzero((label[low:high] != label[k]) & (most >= least) & (_needed(n[low:high], similarity) <= n[k])) + low
    apart = np.bitwise_count(bits[near] ^ bits[k]).sum(axis=1, dtype=np.int64)
    return near[both[near - low] - apart >= 2 * least[near - low]]


def _pairs_in(lists: DataFrame, keys: list[str], limit: int, similarity: float) -> DataFrame:
    """``a, b, block``: pairs of each list that may be similar, ``block`` being null, with the
    other columns; and the members of lists of over ``limit``, in blocks of so many, ``b`` being null."""
    columns = [*keys, "label", "norm", "n", "place", "block", "signature"]
    cells = "low" in keys

    def pair(batches):
        key, held, size, seen = None, [], 0, 0
        dense = False

        def made(a, b, rows=None) -> pa.RecordBatch:
            rest = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            if rows is not None:
                label, norm, n, place, block, bits = rows
                one = [pa.array(np.full(len(norm), key[0], np.int64)), *map(pa.array, (label, n, place, block))]
                rest = [*one, pa.array([bytes(x) for x in bits], pa.binary())]
            names = ["a", "b", "shingle", "label", "n", "place", "block", "signature"]
            return pa.RecordBatch.from_arrays([pa.array(a), b if isinstance(b, pa.Array) else pa.array(b), *rest], names)

        def compared():
            rows = [np.concatenate(x) for x in zip(*held)]
            order = np.lexsort((rows[1], rows[2]))
            rows = [x[order] for x in rows]
            # A text that several tasks posted is one.
            once = np.ones(len(order), bool)
            once[1:] = rows[1][1:] != rows[1][:-1]
            rows = [x[once] for x in rows]
            norm, n, block = rows[1], rows[2], rows[4]
            ends = np.searchsorted(_needed(n, similarity), n, side="right")
            left, right, total = [], [], 0
            for k in range(len(norm) - 1):
                near = _possible(rows, k, k + 1, int(ends[k]), similarity) if ends[k] > k + 1 else ()
                if cells and key[1] != key[2] and len(near):
                    near = near[block[near] != block[k]]
                if len(near):
                    left.append(np.full(len(near), norm[k]))
                    right.append(norm[near])
                    total += len(near)
                if total > 1 << 16 or (k == len(norm) - 2 and total):
                    yield made(np.concatenate(left), np.concatenate(right))
                    left, right, total = [], [], 0

        def parted():
            nonlocal held, seen
            rows = [np.concatenate(x) for x in zip(*held)]
            rows[4] = (seen + np.arange(len(rows[1]))) // limit
            seen, held = seen + len(rows[1]), []
            return made(rows[1], pa.nulls(len(rows[1]), pa.int64()), rows)

        for batch in batches:
            own = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(keys))])
            label, norm, n, place, block = (
                batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(keys), len(columns) - 1)
            )
            bits = np.frombuffer(b"".join(batch.column(len(columns) - 1).to_pylist()), np.uint64).reshape(-1, SIGNATURE_BITS // 64)
            rows = [label, norm, n, place, block, bits]
            cuts = np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if (this := tuple(own[:, i].tolist())) != key:
                    if not dense and size > 1:
                        yield from compared()
                    key, held, size, seen, dense = this, [], 0, 0, False
                held.append([x[i:j] for x in rows])
                size += j - i
                dense = dense or size > limit
                if dense:
                    yield parted()
        if not dense and size > 1:
            yield from compared()

    schema = "a long, b long, shingle long, label long, n long, place long, block long, signature binary"
    return map_arrow(lists.select(columns), pair, schema, 8192)


def remaining_pairs(
    docs: DataFrame, nodes: DataFrame, labels: DataFrame, counts: np.ndarray, limit: int = LIST_LIMIT, similarity: float = SIMILARITY
) -> DataFrame:
    """``u, v``: every pair of ``nodes`` with different ``label`` that may be similar.

    This is exact: similar sets have a shingle in common among the first of each, whatever the
    order, so they meet in a list; sizes, places and signatures only rule out pairs that can't be
    similar. Lists of one label end early. Lists of over ``limit`` are compared block by block.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = prefix_postings(docs, counts, similarity).join(labels, "norm", "left")
    posted = posted.withColumn("label", F.coalesce("label", "norm"))
    own = Window.partitionBy("shingle")
    dealt = posted.repartition(n, "shingle").select("*", F.min("label").over(own).alias("low"), F.max("label").over(own).alias("top"))
    mixed = dealt.filter("low <> top").drop("low", "top")
    signed = mixed.join(nodes.select("norm", "signature"), "norm").withColumn("block", F.lit(0).cast("long"))
    lists = signed.repartition(n, "shingle").sortWithinPartitions("shingle", "norm")
    found = gathered(_pairs_in(lists, ["shingle"], limit, similarity), "meetings", "a")
    pairs = found.filter("block is null").select("a", "b")
    dense = found.filter("block is not null").drop("b").withColumnRenamed("a", "norm")
    if not dense.isEmpty():
        last = dense.groupBy("shingle").agg(F.max("block").alias("last"))
        each = dense.join(last, "shingle").withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
        cells = each.withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with"))
        keys = ["shingle", "low", "high"]
        dealt = cells.repartition(n, *keys).sortWithinPartitions(*keys, "norm")
        pairs = pairs.union(gathered(_pairs_in(dealt, keys, 2 * limit, similarity), "cells", "a").select("a", "b"))
    return stored(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "pairs")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``a, b``: the ``pairs`` (``u, v``) of ``nodes`` (``norm, head``) whose 5-word shingles, read from
    the texts of ``docs``, are similar enough."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("norm")).distinct().join(nodes, "norm")
    wanted = stored(wanted.select("norm", "head.doc_id", "head.text_hash"), "wanted")
    few = wanted.count() <= BROADCAST_TEXTS

    def shingles(batches):
        for batch in batches:
            for at, block in _text_blocks(text_bytes(batch.column(1))):
                owner, h = shingle_sets(block)
                ends = np.searchsorted(owner, np.arange(len(block) + 1)).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), sets], ["norm", "shingles"])

    rows = docs.select("doc_id", text_hash().alias("text_hash"), "text")
    texts = rows.join(F.broadcast(wanted) if few else wanted, ["doc_id", "text_hash"]).select("norm", "text")
    sets = map_arrow(texts, shingles, "norm long, shingles array<long>").groupBy("norm").agg(F.first("shingles").alias("s"))
    sets = stored(sets, "shingles")
    both = pairs.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v")
    common = F.size(F.array_intersect("x", "y"))
    alike = common >= similarity * (F.size("x") + F.size("y") - common)
    return both.filter(alike).select(F.col("u").alias("a"), F.col("v").alias("b"))


def copy_links(
    docs: DataFrame, nodes: DataFrame, counts: np.ndarray, limit: int = LIST_LIMIT, similarity: float = SIMILARITY
) -> DataFrame:
    """``a, b``: verified links that connect all ``nodes`` (``norm, fps, signature, head``) that
    similar pairs connect.

    First a forest of the candidates by either fingerprint is verified. Of what the links found don't
    connect yet, every pair that may be similar is verified, so none is lost to the forest or the
    fingerprints.
    """
    links = candidates(nodes, 0, limit).union(candidates(nodes, 1, limit))
    near = stored(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "pairs")
    first = stored(verified(docs, nodes, near, similarity), "first_links")
    labels = components(first).toDF("norm", "label")
    rest = remaining_pairs(docs, nodes, labels, counts, limit, similarity)
    return first.union(verified(docs, nodes, rest, similarity))


def keep_one_copy(docs: DataFrame, limit: int = LIST_LIMIT, similarity: float = SIMILARITY) -> DataFrame:
    """The same columns, one row of each group of near copies: that with the least doc_id, then
    the least text hash. Texts are copies if they have the same words or are verified to share
    ``similarity`` of their 5-word shingles; groups are what such links connect.

    Most are found by the same index with other parameters: two fingerprints of distinct two-word
    shingles, which stay near where 5-word shingles of similar texts already differ; three shared
    bytes and 12 bits in one, 16 bits in the other. An index of first shingles completes them
    (``remaining_pairs``), so that the groups are those of all similar pairs. Rows without doc_id stay
    as they are.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def compute(batches):
        counts = np.zeros(COUNTERS, np.int64)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary()]
        names = ["text_hash", "norm", "fps", "signature", "part", "counts"]
        id_kind = pa.null()
        for batch in batches:
            id_kind = batch.column(0).type
            texts = text_bytes(batch.column(2))
            fps = np.stack([simhash(texts, FEATURE_WORDS, True, seed) for seed in COPY_SEEDS], axis=1)
            signatures = []
            for _, block in _text_blocks(texts):
                owner, h = shingle_sets(block)
                signatures += _signatures(owner, h, len(block))
                counts += np.bincount(_counter(h), minlength=COUNTERS)
            ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(COPY_SEEDS))
            norm = [xxhash.xxh64_intdigest(b" ".join(t.lower().split())) for t in texts]
            columns = [
                batch.column(1), pa.array(np.array(norm, np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(ends, pa.array(fps.reshape(-1).view(np.int64))), pa.array(signatures, pa.binary()),
                *(pa.nulls(len(texts), kind) for kind in kinds[4:]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])
        if counts.any():
            columns = [pa.nulls(_PARTS, kind) for kind in kinds[:4]]
            columns += [pa.array(np.arange(_PARTS, dtype=np.int32)), pa.array([x.tobytes() for x in counts.reshape(_PARTS, -1)])]
            yield pa.RecordBatch.from_arrays([pa.nulls(_PARTS, id_kind), *columns], ["doc_id", *names])

    known = docs.filter("doc_id is not null")
    named = known.select("doc_id", text_hash().alias("text_hash"), "text")
    schema = f"doc_id {id_type}, text_hash long, norm long, fps array<long>, signature binary, part int, counts binary"
    made = stored(map_arrow(named, compute, schema), "copies")
    counts = shingle_counts(made.filter("part is not null"))
    least = F.min(F.struct("doc_id", "text_hash")).alias("head")
    rows = made.filter("part is null").groupBy("norm")
    nodes = rows.agg(F.min("fps").alias("fps"), F.min("signature").alias("signature"), least)
    nodes = stored(nodes, "nodes")
    labels = components(copy_links(known, nodes, counts, limit, similarity)).toDF("norm", "label")
    grouped = nodes.join(labels, "norm", "left").groupBy(F.coalesce("label", "norm").alias("of"))
    kept = grouped.agg(F.min("head").alias("head")).select("head.doc_id", "head.text_hash")
    return _rows_of(docs, kept)
