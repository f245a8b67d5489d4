"""Exact Jaccard join of word-shingle sets through token-combination prefixes.

Tokens (hashed shingles) have one global order: rare ones first, frequent ones last. Two sets with
Jaccard >= t share at least `a` tokens, a = ceil(t * size). If each set's prefix is its first
`size - a + k` tokens, the prefixes share at least k. Frequent tokens are dealt into c classes and
k = c + 1, so two such prefixes share a rare token, or two frequent tokens of one class: the index
holds single rare tokens and 2-combinations of frequent tokens of one class. c grows with the size
so that combinations stay in proportion to the text; as both sets need the same c, each set is
indexed for its own size level and the next (levels are a factor 1/t wide).

Candidates are first held against each other by parity bitmaps of their sets, 1 to 2 bits a token:
two sets differ in at least as many tokens as their bitmaps in bits. That bound drops no link, and
nearly all pairs that only share common phrases, so that only sets of the others are written
and moved whole. What is left is verified on whole sets. Index entries with few sets give all their pairs; for one
with many sets, first each set is compared with one hub, and then only sets that are not yet in the
main component of their cluster are compared with all of it, in blocks, as matrix products. Where entries
that hang together by chance make a cluster large, each of them is compared by itself instead. Links
are those of connectivity: no link between different components is lost, no group is expanded.

Counts: token frequencies are taken over all documents. The broadcast order table holds the most
frequent tokens only, at most TABLE_TOKENS (16 bytes each), whatever the input; tokens beyond it
count as rare, which costs time in a very large corpus but never a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .storage import Workspace, bound_batches, broadcast_if_small, join_groups, release_memory, tidy
from .textbytes import arrow_texts, mix, set_id, shingle_sets

TABLE_TOKENS = 1 << 20
FREQUENT = 16  #: from so many sets on a token is indexed in combinations
FEW = 16  #: an index entry of so many sets gives all its pairs
BLOCK = 256  #: sets in a block of the last comparison
DEALT_ROWS = 1 << 14  #: so many sets of units of one block go to one group
BUCKET_TOKENS = 1 << 20
_U = np.uint64
_CLASS_F = FREQUENT.bit_length()


def _batches(it: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(doc_id, set, set's id) of each document."""
    for batch in it:
        data, offs = arrow_texts(batch.column("text"))
        for doc, tokens in zip(batch.column("doc_id").to_pylist(), shingle_sets(data, offs, width), strict=True):
            yield doc, tokens, set_id(tokens)


def parity_bits(tokens: np.ndarray) -> bytes:
    """A bitmap of a power of two of bits, 64 or as many as tokens at least; a bit is set if it has an odd number of them."""
    if not len(tokens):
        return b""
    bits = 1 << max(6, (len(tokens) - 1).bit_length())
    held = np.bincount((tokens & _U(bits - 1)).view(np.int64), minlength=bits)
    return np.packbits((held & 1).astype(np.uint8), bitorder="little").tobytes()


def _fold(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Rows of a bitmap's 64-bit words as the bitmaps of `words` words that the same sets have."""
    while bitmaps.shape[1] > words:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


def may_link(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of sizes a and b can have Jaccard similarity num / den, by their bitmaps (rows x and y, one of them may be a single row)."""
    words = min(x.shape[1], y.shape[1])
    apart = np.bitwise_count(_fold(x, words) ^ _fold(y, words)).sum(1, dtype=np.int64)
    both = np.minimum((a + b - apart) // 2, np.minimum(a, b))
    return den * both >= num * (a + b - both)


def _sizes(width: int):
    def run(it):
        for batch in it:
            data, offs = arrow_texts(batch.column("text"))
            sets = list((len(s), set_id(s), parity_bits(s)) for s in shingle_sets(data, offs, width))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([s[k] for s in sets], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary())))], ["doc_id", "n", "sid", "bits"])

    return run


def _runs(keys: np.ndarray, buckets: int, *more: np.ndarray) -> Iterator[tuple]:
    """Cuts sorted uint64 keys (and arrays beside them) by bucket."""
    shift = _U(64 - buckets.bit_length() + 1)
    of = (keys >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.diff(of)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
        if b > a:
            yield (int(of[a]), *(x[a:b].tobytes() for x in (keys, *more)))


def _power_of_two(x: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, x)))))


def _count_pieces(width: int, buckets: int):
    """Tokens with the number of sets they are in, merged a few MB at a time."""

    def flush(held):
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        rows = list(_runs(tokens, buckets, counts.astype(np.uint16 if counts.max() < 65536 else np.uint32)))
        wide = [counts.max() >= 65536] * len(rows)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), pa.array(wide, pa.bool_())], ["bucket", "tokens", "counts", "wide"])

    def run(it):
        seen, held, n = set(), [], 0
        for _, tokens, sid in _batches(it, width):
            if len(tokens) < 4 or sid in seen:
                continue
            seen.add(sid)
            held.append(tokens)
            n += len(tokens)
            if n >= 2 * BUCKET_TOKENS:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def _tidy_group(run):
    """A function of a group's table after which a reused worker keeps no memory that later groups and tasks do not need."""

    def go(table: pa.Table) -> pa.Table:
        out = run(table)
        del table
        release_memory()
        return out

    return go


def _count_merge(table: pa.Table) -> pa.Table:
    tokens, counts = [], []
    for t, c, wide in zip(table.column("tokens"), table.column("counts"), table.column("wide"), strict=True):
        tokens.append(np.frombuffer(t.as_buffer(), np.uint64))
        counts.append(np.frombuffer(c.as_buffer(), np.uint32 if wide.as_py() else np.uint16).astype(np.int64))
    t, c = np.concatenate(tokens), np.concatenate(counts)
    order = np.argsort(t, kind="stable")
    t, c = t[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    total = np.add.reduceat(c, at)
    often = total > 2
    return pa.table({"token": t[at][often].view(np.int64), "df": total[often]})


def _index_keys(tokens: np.ndarray, order_tokens: np.ndarray, order_class: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of one set: single rare tokens, and keys of combinations."""
    n = len(tokens)
    need = (n * num + den - 1) // den
    cls = np.full(n, -1, np.int16)
    # rare tokens first, then frequent ones by class
    if len(order_tokens):
        at = np.minimum(np.searchsorted(order_tokens, tokens), len(order_tokens) - 1)
        hit = order_tokens[at] == tokens
        cls[hit] = order_class[at[hit]]
    order = np.argsort(cls, kind="stable")
    ordered, cls = tokens[order], cls[order]
    frequent = cls >= _CLASS_F
    level = int(np.floor(np.log(n) / np.log(den / num) + 1e-9))
    combos, longest = [], 0
    for lv in (level, level + 1):
        c = max(1, int((den / num) ** lv) // 32)
        p = min(n, n - need + c + 1)
        longest = max(longest, p)
        f = ordered[:p][frequent[:p]]
        if len(f) < 2:
            continue
        part = f % _U(c)
        by = np.argsort(part, kind="stable")
        f, part = f[by], part[by]
        for d in range(1, len(f)):
            same = part[d:] == part[:-d]
            if not same.any():
                break
            a, b = f[:-d][same], f[d:][same]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            combos.append(mix(mix(lo) + hi * _U(0x9E3779B97F4A7C15) + _U(lv)))
    singles = ordered[:longest][~frequent[:longest]]
    return singles, np.unique(np.concatenate(combos)) if combos else np.zeros(0, np.uint64)


def _index_pieces(width: int, buckets: int, table, num: int, den: int):
    names = ["bucket", "keys", "sids"]

    def flush(held, sids, bucket=None):
        keys = np.concatenate(held)
        owner = np.repeat(np.array(sids, np.int64), [len(h) for h in held])
        if bucket is None:
            by = np.argsort(keys, kind="stable")
            rows = list(_runs(keys[by], buckets, owner[by]))
        else:
            rows = [(bucket, keys.tobytes(), owner.tobytes())]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], names)

    def run(it):
        order_tokens, order_class = table.value
        seen = set()
        held: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}
        n = {False: 0, True: 0}
        for _, tokens, sid in _batches(it, width):
            if len(tokens) < 4 or sid in seen:  # smaller sets link with equal sets only
                continue
            seen.add(sid)
            for combined, keys in enumerate(_index_keys(tokens, order_tokens, order_class, num, den)):
                c = bool(combined)
                if len(keys):
                    held[c][0].append(keys)
                    held[c][1].append(sid)
                    n[c] += len(keys)
                    if n[c] >= BUCKET_TOKENS:
                        yield flush(*held[c], -1 if c else None)
                        held[c], n[c] = ([], []), 0
        for c in held:
            if n[c]:
                yield flush(*held[c], -1 if c else None)

    return run


def _index_merge(table: pa.Table) -> pa.Table:
    """Of one bucket of single tokens: pairs of sets with an entry in common (key 0), and the sets (sid, key) of entries with many."""
    keys = np.concatenate([np.frombuffer(k.as_buffer(), np.uint64) for k in table.column("keys")])
    sids = np.concatenate([np.frombuffer(s.as_buffer(), np.int64) for s in table.column("sids")])
    by = np.lexsort((sids, keys))
    keys, sids = keys[by], sids[by]
    keep = np.concatenate([[True], (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])])
    keys, sids = keys[keep], sids[keep]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(at, len(keys)))
    pairs = []
    for g in range(2, FEW + 1):
        first = at[size == g]
        if len(first):
            m = sids[first[:, None] + np.arange(g)]
            i, j = np.triu_indices(g, 1)
            pairs.append(np.stack([m[:, i].ravel(), m[:, j].ravel()], 1))
    found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    many = np.repeat(size > FEW, size)
    k, s = keys[many].view(np.int64), sids[many]
    return pa.table({"key": np.concatenate([np.zeros(len(found), np.int64), k]), "a": np.concatenate([found[:, 0], s]), "b": np.concatenate([found[:, 1], s])})


def _unpack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for k, s in zip(batch.column("keys"), batch.column("sids"), strict=True):
            keys, sids = np.frombuffer(k.as_buffer(), np.int64), np.frombuffer(s.as_buffer(), np.int64)
            for i in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 17)]), pa.array(sids[i : i + (1 << 17)])], ["key", "sid"])


def _sets(width: int):
    def run(it):
        for batch in it:
            data, offs = arrow_texts(batch.column("text"))
            blobs = [s.tobytes() for s in shingle_sets(data, offs, width)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(blobs, pa.binary())], ["node", "tokens"])

    return run


def _by_width(blobs) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Bitmaps of one width in a matrix, with their positions."""
    rows = [np.frombuffer(b.as_buffer(), np.uint64) for b in blobs]
    width = np.array([len(r) for r in rows], np.int64)
    return {int(w): ((at := np.flatnonzero(width == w)), np.stack([rows[i] for i in at])) for w in np.unique(width)}


def _candidates(num: int, den: int):
    """Pairs that their bitmaps do not rule out."""

    def run(it):
        for batch in it:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            keep = np.zeros(len(na), bool)
            xs, ys = _by_width(batch.column("x")), _by_width(batch.column("y"))
            for at, x in xs.values():
                for to, y in ys.values():
                    both, i, j = np.intersect1d(at, to, assume_unique=True, return_indices=True)
                    if len(both):
                        keep[both] = may_link(na[both], x[i], nb[both], y[j], num, den)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])

    return run


def _candidates_of_blocks(num: int, den: int):
    """Of two blocks' sets those that may link with one of the other block in another component; a table may hold several pairs of blocks."""
    names = ["cluster", "i", "j", "left", "node", "component"]

    def likely(left: np.ndarray, n: np.ndarray, comp: np.ndarray, bits: pa.ChunkedArray) -> np.ndarray:
        keep = np.zeros(len(left), bool)
        widths = _by_width(bits)
        for wx, (at, x) in widths.items():
            for wy in (wx // 2, wx, wx * 2):  # sets that link differ in size by less than a factor of 2
                if wy not in widths:
                    continue
                to, y = widths[wy]
                to, y = to[~left[to]], _fold(y[~left[to]], wx)
                for i, row in zip(at[left[at]], _fold(x, min(wx, wy))[left[at]], strict=True):
                    found = to[may_link(n[i], row[None], n[to], y, num, den) & (comp[to] != comp[i])]
                    keep[found] = True
                    keep[i] |= len(found) > 0
        return keep

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("cluster", "i", "j")])
        left = table.column("left").to_numpy()
        n, comp, *unit = (table.column(c).to_numpy() for c in ("n", "component", "cluster", "i", "j"))
        new = np.any([u[1:] != u[:-1] for u in unit], axis=0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(left)]
        keep = [likely(left[x:y], n[x:y], comp[x:y], table.column("bits").slice(x, y - x)) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        return table.select(names).filter(pa.array(np.concatenate(keep), pa.bool_()))

    return run


def _verify(num: int, den: int):
    def run(it):
        for batch in it:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])

    return run


def _compare_blocks(num: int, den: int):
    """Links between the sets of two blocks that are in different components; overlaps by matrix products over slices of their tokens."""

    def run(table: pa.Table) -> pa.Table:
        left = np.array(table.column("left").to_pylist(), bool)
        node = table.column("node").to_numpy()
        comp = table.column("component").to_numpy()
        blobs = table.column("tokens")
        sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in blobs]
        li, ri = np.flatnonzero(left), np.flatnonzero(~left)
        out_a, out_b = [], []
        if len(li) and len(ri):
            ltok, rtok = np.concatenate([sets[i] for i in li]), np.concatenate([sets[i] for i in ri])
            lrow, rrow = np.repeat(np.arange(len(li)), [len(sets[i]) for i in li]), np.repeat(np.arange(len(ri)), [len(sets[i]) for i in ri])
            both = np.intersect1d(ltok, rtok)
            lcol, rcol = np.searchsorted(both, ltok), np.searchsorted(both, rtok)
            lok, rok = lcol < len(both), rcol < len(both)
            lok[lok] = both[lcol[lok]] == ltok[lok]
            rok[rok] = both[rcol[rok]] == rtok[rok]
            lrow, lcol, rrow, rcol = lrow[lok], lcol[lok], rrow[rok], rcol[rok]
            overlap = np.zeros((len(li), len(ri)), np.float32)
            for c in range(0, len(both), 4096):
                m = [np.zeros((n, min(4096, len(both) - c)), np.float32) for n in (len(li), len(ri))]
                for mat, row, col in ((m[0], lrow, lcol), (m[1], rrow, rcol)):
                    s = (col >= c) & (col < c + 4096)
                    mat[row[s], col[s] - c] = 1
                overlap += m[0] @ m[1].T
            ln, rn = np.array([len(sets[i]) for i in li]), np.array([len(sets[i]) for i in ri])
            o = overlap.astype(np.int64)
            linked = (den * o >= num * (ln[:, None] + rn[None, :] - o)) & (comp[li][:, None] != comp[ri][None, :])
            x, y = np.nonzero(linked)
            out_a, out_b = comp[li][x], comp[ri][y]
            if len(out_a):
                pairs = np.unique(np.stack([np.minimum(out_a, out_b), np.maximum(out_a, out_b)], 1), axis=0)
                out_a, out_b = pairs[:, 0], pairs[:, 1]
        del node
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def ngram_components(docs: DataFrame, width: int = 5, numerator: int = 4, denominator: int = 5) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id long, n_shingles long, component_id long), a row for each row of docs.

    Documents whose sets of `width`-word shingles have Jaccard similarity of at least
    numerator / denominator are linked; component_id is the least doc_id reachable by links, the own
    one included. Texts that are null, empty or without words have an empty set and no links; equal
    sets are linked whatever their number; fewer words than `width` make one shingle. Rows that repeat a
    doc_id are the same document; a row without doc_id links nothing and gets the component of its set,
    null if no other row has that set. Other columns of docs are ignored, whatever their names.
    """
    spark = docs.sparkSession
    if numerator * 5 < denominator * 4:
        raise ValueError("similarities under 0.8 are not supported")
    work = Workspace(spark, "ngram-join")
    texts = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    sizes = work.write(texts.mapInArrow(tidy(_sizes(width)), "doc_id long, n long, sid long, bits binary"), "sizes")
    # a set's node is the least doc_id that has it
    nodes = work.write(sizes.where("n > 0 and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("node"), F.max("n").alias("n")), "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    links = _links(spark, work, texts, sizes, nodes, total, width, numerator, denominator)
    parts = connected_components(links, work, "parts")
    found = nodes.join(parts, "node", "left").select("sid", F.coalesce("component", "node").alias("component_id"))
    return sizes.join(found, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def order_table(spark: SparkSession, work: Workspace, texts: DataFrame, total: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens (sorted hashes) with the bit length of the number of sets they are in: as many classes as fit TABLE_TOKENS."""
    buckets = _power_of_two(total / BUCKET_TOKENS)
    pieces = texts.mapInArrow(tidy(_count_pieces(width, buckets)), "bucket int, tokens binary, counts binary, wide boolean")
    often = work.write(pieces.groupBy("bucket").applyInArrow(_tidy_group(_count_merge), "token long, df long"), "often")
    rank = F.ceil(8 * F.log2(F.col("df"))).cast("int")
    by_df = often.groupBy(rank.alias("k")).agg(F.count("*").alias("c")).collect()  # at most 504 rows
    room, least = TABLE_TOKENS, 505
    for k, c in sorted(((r["k"], r["c"]) for r in by_df), reverse=True):
        if c > room:
            break
        room, least = room - c, k
    got = often.where(rank >= least).toArrow()  # at most TABLE_TOKENS rows
    tokens, df = got.column("token").to_numpy().view(np.uint64), got.column("df").to_numpy()
    by = np.argsort(tokens)
    work.drop("often")
    table = tokens[by].copy(), np.frexp(df[by].astype(np.float64))[1].astype(np.int8)
    del got, tokens, df
    release_memory()
    return table


def _links(spark: SparkSession, work: Workspace, texts: DataFrame, sizes: DataFrame, nodes: DataFrame, total: int, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between nodes that connect every component."""

    def whole_sets(wanted: DataFrame, name: str) -> DataFrame:
        wanted = broadcast_if_small(work.write(wanted.distinct(), f"{name}-nodes"))
        some = texts.join(wanted, F.col("doc_id") == F.col("node"), "left_semi").select(F.col("doc_id").alias("node"), "text")
        return work.write(some.mapInArrow(tidy(_sets(width)), "node long, tokens binary"), name)

    # as whole sets, a row for each row of texts that has the node's doc_id
    bitmaps = sizes.where("n > 3").select(F.col("doc_id").alias("node"), "n", "bits")
    table = spark.sparkContext.broadcast(order_table(spark, work, texts, total, width))
    buckets = _power_of_two(total * 0.3 / BUCKET_TOKENS)
    index = work.write(texts.mapInArrow(tidy(_index_pieces(width, buckets, table, num, den)), "bucket int, keys binary, sids binary"), "index")
    singles = work.write(index.where("bucket >= 0").groupBy("bucket").applyInArrow(_tidy_group(_index_merge), "key long, a long, b long"), "singles")
    combos = work.write(index.where("bucket < 0").select("keys", "sids").mapInArrow(_unpack, "key long, sid long").distinct(), "combos")
    work.drop("index")
    shared = work.write(combos.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    to_node = nodes.select("sid", "node", "n")
    members = join_groups(combos, shared, ["key"], "c", "left_semi").select("key", "sid").union(singles.where("key <> 0").select("key", F.col("a").alias("sid")))
    members = work.write(members.join(to_node, "sid").select("key", "node", "n"), "members")
    work.drop("combos"), work.drop("shared")

    # an entry that many sets share meets its hub by a broadcast
    hub = members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("h"), F.count("*").alias("c")).select("key", F.col("h.node").alias("a"), F.col("h.n").alias("na"), "c")
    near = join_groups(members, work.write(hub, "hubs"), ["key"], "c").where("node <> a").select("a", F.col("node").alias("b"), "na", F.col("n").alias("nb"))
    x, y = (to_node.toDF(f"s{k}", f"d{k}", f"n{k}") for k in "xy")
    few = singles.where("key = 0").join(x, F.col("a") == F.col("sx")).join(y, F.col("b") == F.col("sy"))
    few = few.select(F.least("dx", "dy").alias("a"), F.greatest("dx", "dy").alias("b"), F.col("nx").alias("na"), F.col("ny").alias("nb"))
    fits = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    pairs = work.write(near.union(few).where(fits).select("a", "b").distinct(), "pairs")
    work.drop("singles"), work.drop("hubs")
    held = pairs.join(bitmaps.toDF("a", "na", "x"), "a").join(bitmaps.toDF("b", "nb", "y"), "b").select("a", "b", "na", "nb", "x", "y")
    likely = work.write(held.mapInArrow(tidy(_candidates(num, den)), "a long, b long").distinct(), "likely")
    work.drop("pairs")
    sets = whole_sets(likely.select(F.col("a").alias("node")).union(likely.select("b")), "sets")
    first = likely.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    links = work.write(first.mapInArrow(tidy(_verify(num, den)), "a long, b long"), "links")
    work.drop("sets"), work.drop("likely")

    # entries whose sets are still in several components: their clusters, compared in blocks
    parts = connected_components(links, work, "first")
    placed = members.select("key", "node").join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("b"), F.max("component").alias("hi"), F.count("*").alias("c")).where("b < hi and c > 2").select("key", "b", "c")  # of two sets one is the hub
    placed = work.write(join_groups(placed, work.write(open_, "open"), ["key"], "c").select("key", "node", "component", "b"), "placed")
    work.drop("members"), work.drop("open")
    if placed.isEmpty():
        return links
    # of entries with the same sets, one
    marks = (F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in (0, 1))
    alike = placed.groupBy("key").agg(F.count("*").alias("c"), F.first("b").alias("b"), *marks)
    kinds = alike.groupBy("c", "x0", "x1").agg(F.min(F.struct("key", "b")).alias("k")).select("k.key", "k.b", "c")
    kinds = work.write(kinds, "kinds")
    placed = work.write(join_groups(placed, kinds.select("key", "c"), ["key"], "c", "left_semi"), "placed-once")
    work.drop("placed")
    star = placed.select(F.col("component").alias("a"), "b")
    clusters = broadcast_if_small(connected_components(star, work, "clusters").toDF("component", "cluster"))
    # all sets of the components that meet in an open entry, as far as they are in open entries
    open_nodes = work.write(placed.select("node", "component").distinct().join(clusters, "component").select("cluster", "node", "component"), "open-nodes")
    # entries that meet by chance make large clusters, which then take far more comparisons than the entries one by one
    whole = work.write(_shapes(open_nodes), "cluster-shapes")
    single = _shapes(placed.select(F.col("key").alias("cluster"), "node", "component")).withColumnRenamed("cluster", "key")
    single = single.join(kinds.select("key", F.col("b").alias("component")), "key").join(clusters, "component").drop("component")
    single = work.write(single, "entry-shapes")
    cost = F.col("all").cast("double") * F.col("rest")
    apart = single.groupBy("cluster").agg(F.sum(cost).alias("apart")).join(whole, "cluster").where(F.col("apart") < cost).select("cluster")
    apart = broadcast_if_small(work.write(apart, "apart"))
    units = single.join(apart, "cluster", "left_semi").drop("cluster").withColumnRenamed("key", "cluster")
    units = work.write(units.unionByName(whole.join(apart, "cluster", "left_anti")), "units")
    rows = open_nodes.join(apart, "cluster", "left_anti").unionByName(placed.select(F.col("key").alias("cluster"), "node", "component"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    every = join_groups(rows, units.select("cluster", "all", "main", blocks("all").alias("rights"), blocks("rest").alias("lefts")), ["cluster"], "all")
    # units of one block share a group with others
    groups = max(1, (units.where(F.col("all") <= BLOCK).agg(F.sum("all")).first()[0] or 0) // DEALT_ROWS)
    deal = F.when(F.col("rights") == 1, F.pmod(F.xxhash64("cluster"), F.lit(groups))).otherwise(F.xxhash64("cluster", "i", "j"))
    left = every.where("component <> main").select("cluster", F.lit(True).alias("left"), "node", "component", F.pmod(F.xxhash64("node"), F.col("lefts")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"), "rights")
    right = every.select("cluster", F.lit(False).alias("left"), "node", "component", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), F.pmod(F.xxhash64("node"), F.col("rights")).cast("int").alias("j"), "rights")
    dealt = left.select(*right.columns).union(right).withColumn("deal", deal).drop("rights").join(bitmaps, "node")
    kind = "cluster long, i int, j int, left boolean, node long, component long"
    likely = work.write(dealt.groupBy("deal").applyInArrow(_tidy_group(_candidates_of_blocks(num, den)), kind).distinct(), "likely-blocks")
    sets = whole_sets(likely.select("node"), "block-sets")
    more = likely.join(sets, "node").groupBy("cluster", "i", "j").applyInArrow(_tidy_group(_compare_blocks(num, den)), "a long, b long")
    links = work.write(links.union(more.distinct()), "all-links")
    work.drop("block-sets")
    return links


def _shapes(rows: DataFrame) -> DataFrame:
    """(cluster, node, component) -> of each cluster its largest component, the number of its sets, and of those outside that component."""
    main = rows.groupBy("cluster", "component").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("all"))
    return main.select("cluster", F.col("m.component").alias("main"), "all", (F.col("all") - F.col("m.c")).alias("rest"))


def near_duplicate_filter(docs: DataFrame, width: int = 5, numerator: int = 4, denominator: int = 5) -> DataFrame:
    """docs without all but one document (the least doc_id) of each component; all columns are kept. Rows without doc_id stay."""
    gone = ngram_components(docs, width, numerator, denominator).where("doc_id > component_id").select(F.col("doc_id").alias("__gone"))
    gone = broadcast_if_small(Workspace(docs.sparkSession, "ngram-gone").write(gone, "gone"))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
