"""Documents whose sets of word n-grams are alike, and the groups they form.

The join is PartEnum's. Sets fall into bands of size such that two alike sets
lie in one band or in neighbouring ones. For a band, likeness of ``percent`` or
more leaves room for k differing elements at most. The domain of elements is cut
into n1 parts, each into three; k differences leave some part with one at most,
so two of its three pieces are equal: every pair of pieces (subset of the
partition) is a signature, and alike sets share one. n1 is larger than needed by
a margin, so that a set leaves out signatures of few elements, as far as they are
of no more parts than that: equal ones are of equal size, so one is left that both keep.

Plan: (1) one scan gives each document its size and its set's hash (its node; equal
sets are one node). (2) A second scan makes the signatures of a few thousand
documents at a time; packed, they meet in the bucket of their hash, which names
signatures of two nodes or more. (3) Each node is compared with the
least node under each of its signatures, by histograms of their sets and, if these
don't rule the pair out, in full; links give components, so groups of
copies cost a star, not all pairs. (4) Signatures whose nodes are still in several
components stay open. Their nodes meet with small histograms; pairs that these
don't rule out connect nodes to families, and each meeting hands on no more pairs than
connect what it holds. Small ones tell little of long texts, so the nodes of a family meet
again, once each, with histograms in proportion to their sets, which cut it up. (5) A family meets with its sets: all pairs of different
components are compared by counting shared elements, in dense products for elements
that many hold, in sums for the others. It hands on only links that join components,
fewer than it has nodes. Large meetings are cut in blocks that meet two by two.
So every link between different sets has either been tested or joins what is joined.

Sets are compared by 64-bit hashes of their elements.

Defined cases: null or blank text: an empty set, linked with nothing. Fewer words
than n: the whole sequence is the one element. Null doc_id: its own document;
component_id is null if it is the least of its group (null orders first).
Repeated rows: each is returned. Empty table: no rows. Other columns are not read.
Sets may be of any size that fits a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import small

from . import blobs, common
from .components import components
from .hashing import chunks, distinct, mix, shingles, slices, tidied, tidy, word_hashes

#: Text whose signatures are packed together, and text whose sets are held at once.
CHUNK_BYTES = 4_000_000
SLICE_BYTES = 1_500_000
BUCKET_SIGNATURES = 1_000_000
CELLS = 128
#: Elements to a cell of a histogram in proportion, at most.
PER_CELL = 8
#: Nodes of a block in step 4, and their cells.
BLOCK = 1500
BLOCK_CELLS = 16_000_000
#: Rows that are sent to all tasks.
FEW = 20_000
#: Nodes beside one copy of their centre's set in step 3.
AROUND = 250
#: Nodes of a block in step 5, and their elements.
FAMILY = 10_000
FAMILY_ELEMENTS = 2_000_000
#: Columns of a dense product, sums, and pairs counted at once.
COLUMNS = 1000
SUMS = 2_000_000
PAIRS = 8_000_000
_SIZES = 1 << 40


class Plan:
    """Bands, and n1 for each, for a likeness of percent / 100."""

    def __init__(self, percent: int, most: int = _SIZES):
        self.percent, ends, low = percent, [], 1
        while low <= max(most, 1):
            ends.append(low * 100 // percent)
            low = ends[-1] + 1
        self.ends = np.array(ends)
        after = np.r_[self.ends, low * 100 // percent]
        self.k = 2 * after * (100 - percent) // (100 + percent)
        need = self.k // 2 + 1
        self.margin = np.where(self.k > 0, need // 8, 0)
        self.n1 = need + self.margin

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, sizes)


def _sets(texts: pa.Array, n: int, lower: bool):
    words, counts = word_hashes(texts, lower)
    return distinct(*shingles(words, counts, n))


def _nodes(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each set, as a signed number; of an empty one, nothing of use."""
    sums = np.r_[np.uint64(0), np.cumsum(mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)))]
    to = np.cumsum(counts)
    return mix((sums[to] - sums[to - counts]) ^ counts.astype(np.uint64)).view(np.int64)


def histogram(h: np.ndarray) -> np.ndarray | None:
    """Counts of a set's elements in cells, a power of two of them in proportion to the set; None if CELLS are enough."""
    cells = CELLS
    while cells * PER_CELL < len(h):
        cells *= 2
    return np.minimum(np.bincount((mix(h) & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8) if cells > CELLS else None


def folded(cells: np.ndarray, width: int) -> np.ndarray:
    """A histogram's counts in fewer cells."""
    return cells.reshape(-1, width).sum(0, dtype=np.int16)


def _profile(n: int, lower: bool):
    def run(batches):
        for batch in batches:
            ids, copies, texts = batch.columns
            for a, b in slices(texts, SLICE_BYTES):
                h, counts = _sets(texts.slice(a, b - a), n, lower)
                cells = np.bincount(np.repeat(np.arange(b - a) * CELLS, counts) + (mix(h) % np.uint64(CELLS)).astype(np.int64), minlength=(b - a) * CELLS)
                cells = np.minimum(cells, 255).astype(np.uint8).reshape(b - a, CELLS)
                to, fine = np.cumsum(counts), [None] * (b - a)
                for i in np.flatnonzero(counts > CELLS * PER_CELL).tolist():
                    fine[i] = histogram(h[to[i] - counts[i] : to[i]]).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), copies.slice(a, b - a), pa.array(counts), pa.array(_nodes(h, counts), mask=counts == 0), pa.array([x.tobytes() for x in cells], pa.binary()), pa.array(fine, pa.binary())],
                    names=["id", "copy", "n", "node", "cells", "fine"],
                )

    return run


_SUBSETS = ((0, 1), (0, 2), (1, 2))


def signatures(h: np.ndarray, counts: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, the set that each is of) for non-empty sets; h grouped by set."""
    owner = np.repeat(np.arange(len(counts)), counts)
    spread, third = mix(h ^ np.uint64(0x5851F42D4C957F2D)), mix(h ^ np.uint64(0x14057B7EF767814F))
    out, whose = [], []
    for band in (plan.band(counts), plan.band(counts) + 1):
        n1, exact = plan.n1[band], plan.k[band] == 0
        base = np.cumsum(n1) - n1
        part = base[owner] + ((spread >> np.uint64(32)) * n1[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        at = part * 3 + np.where(exact[owner], 0, (third % np.uint64(3)).astype(np.int64))
        total = int(n1.sum())
        sums, sizes = np.zeros(3 * total, np.uint64), np.bincount(at, minlength=3 * total).reshape(-1, 3)
        np.add.at(sums, at, spread)
        sums = sums.reshape(-1, 3)
        doc = np.repeat(np.arange(len(counts)), n1)
        name = mix((band[doc].astype(np.uint64) << np.uint64(40)) | (np.arange(total) - base[doc]).astype(np.uint64) << np.uint64(2))
        held = np.stack([sizes[:, a] + sizes[:, b] for a, b in _SUBSETS], 1)
        least = np.zeros(len(counts), np.int64)  # elements of a signature; what few parts would lose goes
        for t in (1, 2, 3):
            least += np.bincount(doc[held.min(1) < t], minlength=len(counts)) <= plan.margin[band]
        least[exact] = 0
        for j, (a, b) in enumerate(_SUBSETS):
            keep = held[:, j] >= least[doc]
            if j:
                keep &= ~exact[doc]
            out.append(mix((sums[keep, a] + sums[keep, b]) ^ (name[keep] + np.uint64(j))))
            whose.append(doc[keep])
    return np.concatenate(out), np.concatenate(whose)


def _sign(n: int, lower: bool, plan: Plan, buckets: int):
    def run(batches):
        for chunk in chunks(batches, 0, CHUNK_BYTES):
            h, counts = _sets(chunk.column(0), n, lower)
            nodes = _nodes(h, counts)
            first = np.zeros(len(counts), dtype=bool)
            first[np.unique(nodes, return_index=True)[1]] = True
            first &= counts > 0
            if not first.any():
                continue
            h, counts, nodes = h[np.repeat(first, counts)], counts[first], nodes[first]
            s, whose = signatures(h, counts, plan)
            yield _dealt(s, whose, nodes, buckets)

    return run


def _dealt(s: np.ndarray, whose: np.ndarray, nodes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket that any signature falls in: its signatures, their nodes, and whose each is."""
    by = np.argsort(s)
    s, whose = s[by], whose[by]
    bucket = ((s >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(s) else []
    rows = []
    for i, j in zip(cut, np.r_[cut[1:], len(s)].astype(np.int64) if len(s) else []):
        table, at = np.unique(nodes.view(np.uint64)[whose[i:j]], return_inverse=True)
        rows.append((int(bucket[i]), blobs.pack_rising(table), blobs.pack_rising(s[i:j]), blobs.pack(at)))
    types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, types)], names=["bucket", "nodes", "signatures", "whose"])


def _again(buckets: int):
    """Rows as _dealt() makes them, sorted by coarse bucket -> the same by fine bucket, of some rows at a time."""

    def run(batches):
        held, size, at = [], 0, None
        for batch in batches:
            for k, nodes, sig, whose in zip(*(x.to_pylist() for x in batch.columns)):
                if held and (k != at or size > common.HELD):
                    yield _dealt(np.concatenate([x for x, _ in held]), np.arange(size), np.concatenate([x for _, x in held]), buckets)
                    held, size = [], 0
                at, s = k, blobs.unpack_rising(sig)
                held.append((s, blobs.unpack_rising(nodes).view(np.int64)[blobs.unpack(whose).astype(np.int64)]))
                size += len(s)
        if held:
            yield _dealt(np.concatenate([x for x, _ in held]), np.arange(size), np.concatenate([x for _, x in held]), buckets)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """A bucket's signatures that several nodes have: (signature, node, the least such node)."""
    s, v = [], []
    for nodes, sig, whose in zip(*(table.column(x).to_pylist() for x in ("nodes", "signatures", "whose"))):
        s.append(blobs.unpack_rising(sig))
        v.append(blobs.unpack_rising(nodes).view(np.int64)[blobs.unpack(whose).astype(np.int64)])
    s, v = np.concatenate(s), np.concatenate(v)
    order = np.argsort(s, kind="stable")
    s, v = s[order], v[order]
    many = np.zeros(len(s) + 1, dtype=bool)
    many[1:-1] = s[1:] == s[:-1]
    many = many[1:] | many[:-1]
    s, v = s[many], v[many]
    order = np.lexsort((v, s))
    s, v = s[order], v[order]
    if len(s):
        keep = np.r_[True, (s[1:] != s[:-1]) | (v[1:] != v[:-1])]
        s, v = s[keep], v[keep]
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[starts, len(s)])
        low, keep = np.repeat(v[starts], size), np.repeat(size > 1, size)
        s, v, low = s[keep], v[keep], low[keep]
    else:
        low = v
    tidy()
    return pa.table({"signature": s.view(np.int64), "node": v, "low": low})


def _set_of(n: int, lower: bool):
    """(node, text) -> (node, size, packed set), where the text's set is that node's."""

    def run(batches):
        for batch in batches:
            node, texts = batch.columns
            for a, b in slices(texts, SLICE_BYTES):
                h, counts = _sets(texts.slice(a, b - a), n, lower)
                want, to = node.slice(a, b - a).to_numpy(), np.cumsum(counts)
                rows = [(w, int(c), blobs.pack_rising(h[e - c : e])) for w, e, c, ok in zip(want.tolist(), to, counts, _nodes(h, counts) == want) if ok]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["node", "n", "elements"])

    return run


def _compare(percent: int):
    """Rows sorted so that a centre (other null) stands before those to compare it with."""

    def run(batches):
        centre, mine = None, None
        for batch in batches:
            u, v = [], []
            for c, other, packed in zip(*(x.to_pylist() for x in batch.columns)):
                s = blobs.unpack_rising(packed)
                if other is None:
                    centre, mine = c, s
                elif c == centre:
                    both = len(np.intersect1d(mine, s, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(s) - both):
                        u.append(c)
                        v.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _unruled(percent: int):
    """(u, v, n and cells of both) -> the pairs that histograms don't rule out."""

    def run(batches):
        for batch in batches:
            u, v, sizes, other_sizes = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
            apart = np.zeros(len(u), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist())):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                width = min(len(x), len(y))
                apart[i] = np.abs(folded(x, width) - folded(y, width)).sum(dtype=np.int64)
            keep = apart * (100 + percent) <= (sizes + other_sizes) * (100 - percent)
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])

    return run


def _about(profiles: DataFrame, cells) -> DataFrame:
    """(node, n, cells) of every node."""
    return profiles.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first(cells).alias("cells"))


def _likely(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """pairs: (u, v) nodes. Those that histograms in proportion don't rule out."""
    about = _about(profiles, F.coalesce("fine", "cells"))
    rows = common.join_apart(pairs.withColumnRenamed("u", "node"), about, ["node"]).toDF("u", "v", "n", "cells")
    rows = common.join_apart(rows.withColumnRenamed("v", "node"), about.toDF("node", "m", "others"), ["node"])
    return rows.select("u", F.col("node").alias("v"), "n", "cells", "m", "others").mapInArrow(tidied(_unruled(percent)), "u long, v long")


def _sets_of(wanted: DataFrame, base: DataFrame, profiles: DataFrame, n: int, lower: bool, repeats: bool) -> DataFrame:
    """(node, n, elements) of the wanted nodes, from one text of each."""
    chosen = common.join_apart(profiles.select("node", "id", "copy"), wanted, ["node"]).groupBy("node").agg(F.min(F.struct("id", "copy")).alias("x"))
    chosen = common.materialise(chosen.select("node", "x.id", "x.copy"), "chosen")
    sets = base.join(small(chosen, FEW), ["id", "copy"]).select("node", "text").mapInArrow(tidied(_set_of(n, lower)), "node long, n long, elements binary")
    sets = common.materialise(sets.dropDuplicates(["node"]) if repeats else sets, "sets")
    common.discard(chosen)
    return sets


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs: (u, v) nodes. Those that are alike. u's set is sent once for every AROUND pairs of it."""
    sets = sets.select("node", "elements")
    shares = pairs.groupBy("u").count().select("u", F.expr(f"int(1 + count div {AROUND})").alias("shares"))
    others = common.join_apart(pairs, shares, ["u"]).select("u", F.expr("pmod(xxhash64(v), shares)").alias("share"), "v").join(sets.withColumnRenamed("node", "v"), "v")
    centres = shares.join(sets.withColumnRenamed("node", "u"), "u").select("u", F.explode(F.expr("sequence(0L, shares - 1L)")).alias("share"), F.lit(None).cast("long").alias("v"), "elements")
    rows = centres.unionByName(others.select("u", "share", "v", "elements"))
    rows = rows.repartition("u", "share").sortWithinPartitions("u", "share", F.col("v").asc_nulls_first())
    return rows.select("u", "v", "elements").mapInArrow(tidied(_compare(percent)), "u long, v long")


def connecting(side, node, component, n, cells: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of nodes that connect all those of different components that histograms don't rule out.

    Two histograms differ by no more than their sets do, folded or not; larger sets have no fewer cells."""
    order = np.argsort(n, kind="stable")
    side, node, component, n, cells = *(x[order] for x in (side, node, component, n)), [cells[i] for i in order.tolist()]
    wide = np.array([len(x) for x in cells])
    root, out, width, first = np.arange(len(node)), [], 0, 0
    for i in range(len(node) - 1):
        if wide[i] != width:  # the counts of those as wide, and of those that they are compared with
            width, first = int(wide[i]), i
            to = int(np.searchsorted(n, n[np.searchsorted(wide, width, "right") - 1] * 100 // percent, "right"))
            counts = np.stack([folded(x, width) for x in cells[i:to]])
        j = slice(i + 1, int(np.searchsorted(n, n[i] * 100 // percent, "right")))
        k = np.flatnonzero((component[j] != component[i]) & (root[j] != root[i]) & ((side[j] != side[i]) | (side[i] == 2))) + i + 1
        if len(k):
            apart = np.abs(counts[k - first] - counts[i - first]).sum(1, dtype=np.int64)
            k = k[apart * (100 + percent) <= (n[k] + n[i]) * (100 - percent)]
        while len(k):
            out.append((int(node[i]), int(node[k[0]])))
            root[root == root[k[0]]] = root[i]
            k = k[root[k] != root[i]]
    return out


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]):
    """(number of a first set of left, how many elements it and those behind it share with each of right), some
    sets at a time. right may be left itself; a set's count with itself is of no use.

    An element that c sets hold costs c sums for each, or one column of a product: whichever is less."""
    sets = left if right is left else left + right
    beside = len(sets) - len(right)
    kind = np.float32 if max(map(len, sets)) < 1 << 24 else np.float64
    h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    size = np.diff(np.r_[start, len(h)])
    del h, order
    dense = size > max(8, len(sets) // 12)
    column, of_dense = np.repeat(np.arange(len(size)), size), np.cumsum(dense) - 1
    # entries by set: in columns of few sets, in those of many
    few, many = (np.flatnonzero(x[column]) for x in (~dense & (size > 1), dense))
    few = few[np.argsort(owner[few], kind="stable")]
    few_to, n_dense = np.searchsorted(owner[few], np.arange(len(left) + 1)), int(dense.sum())
    step = max(1, PAIRS // len(right))
    for a in range(0, len(left), step):
        b = min(a + step, len(left))
        out = np.zeros((b - a, len(right)), kind)
        for c in range(0, n_dense, COLUMNS):
            at = many[(of_dense[column[many]] >= c) & (of_dense[column[many]] < c + COLUMNS)]
            m = np.zeros((len(sets), min(COLUMNS, n_dense - c)), kind)
            m[owner[at], of_dense[column[at]] - c] = 1
            out += m[a:b] @ m[beside:].T
        at = few[few_to[a] : few_to[b]]
        to = np.cumsum(size[column[at]])
        c = 0
        while c < len(at):
            d = max(c + 1, int(np.searchsorted(to, (to[c - 1] if c else 0) + SUMS, "right")))
            n = size[column[at[c:d]]]
            x = np.repeat(owner[at[c:d]] - a, n)
            y = owner[np.repeat(start[column[at[c:d]]] - (np.cumsum(n) - n), n) + np.arange(n.sum())] - beside
            x, y = (x, y) if not beside else (x[y >= 0], y[y >= 0])
            np.add.at(out.reshape(-1), x * len(right) + y, 1)
            c = d
        yield a, out


def joining(left: list[np.ndarray], right: list[np.ndarray], component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (numbers of sets, left's before right's) that join components, no more than are needed for that."""
    n = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    beside = 0 if right is left else len(left)
    root, out = np.unique(component, return_inverse=True)[1], []
    for first, both in shared_counts(left, right):
        for i, row in enumerate(both, first):
            js = np.flatnonzero(row) + beside
            js = js[root[js] != root[i]]
            js = js[row[js - beside].astype(np.int64) * (100 + percent) >= percent * (n[0][i] + n[1][js - beside])]
            while len(js):
                out.append((i, int(js[0])))
                root[root == root[js[0]]] = root[i]
                js = js[root[js] != root[i]]
    return out


def _connect(percent: int):
    """Rows of one meeting (side, node, component, n, cells) -> pairs of nodes."""

    def of(table: pa.Table) -> list[tuple[int, int]]:
        cells = [np.frombuffer(x, np.uint8) for x in table.column("cells").to_pylist()]
        return connecting(*(table.column(x).to_numpy() for x in ("side", "node", "component", "n")), cells, percent)

    return of


def _join(percent: int):
    """Rows of one meeting (side, node, component, elements) -> links."""

    def of(table: pa.Table) -> list[tuple[int, int]]:
        side, node, component = (table.column(x).to_numpy() for x in ("side", "node", "component"))
        sets = [blobs.unpack_rising(x) for x in table.column("elements").to_pylist()]
        order = np.argsort(side, kind="stable")
        sets, node, component, cut = [sets[i] for i in order.tolist()], node[order], component[order], int((side == 0).sum())
        if side[0] == 2:
            found = joining(sets, sets, component, percent)
        else:
            found = joining(sets[:cut], sets[cut:], component, percent) if 0 < cut < len(sets) else []
        return [(int(node[i]), int(node[j])) for i, j in found]

    return of


def _by_meeting(what):
    """Rows sorted by meeting -> what each meeting gives, as (u, v)."""

    def run(batches):
        held: list[pa.Table] = []  # of one meeting
        for batch in batches:
            table, found = pa.Table.from_batches([batch]), []
            key = table.column("meeting").to_numpy()
            if held and len(key) and held[0].column("meeting")[0].as_py() != key[0]:
                found += what(pa.concat_tables(held))
                held = []
            cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)].tolist() if len(key) else []
            for a, b in zip(cuts, cuts[1:]):
                held.append(table.slice(a, b - a))
                if b < len(key):
                    found += what(pa.concat_tables(held))
                    held = []
            if found:
                yield batch_of(set(found))
        if held:
            yield batch_of(what(pa.concat_tables(held)))

    def batch_of(found):
        u, v = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _meetings(rows: DataFrame, *carried: str) -> DataFrame:
    """rows: (key, blocks, node, ...). Each node's row once for every meeting of its block with another."""
    rows = rows.withColumn("mine", F.expr("pmod(xxhash64(node), blocks)")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1L)")))
    rows = rows.select(
        F.expr("xxhash64(key, least(mine, other), greatest(mine, other))").alias("meeting"),
        F.expr("case when mine = other then 2 when mine < other then 0 else 1 end").alias("side"), "node", *carried,
    )
    return rows.repartition("meeting").sortWithinPartitions("meeting")


def _families(rows: DataFrame, percent: int) -> DataFrame:
    """rows: (key, blocks, node, component, n, cells). (node, component): those connected in meetings by key."""
    met = _meetings(rows, "component", "n", "cells").mapInArrow(tidied(_by_meeting(_connect(percent))), "u long, v long")
    pairs = common.materialise(met.distinct(), "families")
    family = components(pairs)
    common.discard(pairs)
    return family


def _open_links(shared: DataFrame, labels: DataFrame, profiles: DataFrame, sets_of, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links between nodes that share a signature and are in different components so far,
    enough to join what can be joined; and what was stored for that."""
    placed = shared.join(labels, "node", "left").select("signature", "node", F.coalesce("component", "node").alias("component"))
    open_ = placed.groupBy("signature").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("members")).where("a <> b")
    rows = common.join_apart(placed, open_.select(F.col("signature"), F.expr(f"1 + members div {BLOCK}").alias("blocks")), ["signature"])
    rows = common.materialise(rows.withColumnRenamed("signature", "key"), "open")
    coarse = _families(common.join_apart(rows, _about(profiles, F.col("cells")), ["node"]), percent)
    common.discard(rows)

    about = _about(profiles, F.coalesce("fine", "cells"))
    nodes = common.join_apart(coarse.select("node", F.col("component").alias("key")), about, ["node"]).join(labels, "node", "left")
    nodes = common.materialise(nodes.select("key", "node", F.coalesce("component", "node").alias("component"), "n", "cells"), "members")
    size = nodes.groupBy("key").agg(F.expr(f"1 + greatest(count(1) div {BLOCK}, sum(length(cells)) div {BLOCK_CELLS})").alias("blocks"))
    family = _families(common.join_apart(nodes, size, ["key"]), percent)
    common.discard(coarse, nodes)

    sets = sets_of(family.select("node"))
    nodes = common.join_apart(family.select("node", F.col("component").alias("key")), sets, ["node"]).join(labels, "node", "left")
    nodes = nodes.select("key", "node", F.coalesce("component", "node").alias("component"), "n", "elements")
    size = nodes.groupBy("key").agg(F.expr(f"1 + greatest(count(1) div {FAMILY}, sum(n) div {FAMILY_ELEMENTS})").alias("blocks"))
    met = _meetings(common.join_apart(nodes, size, ["key"]), "component", "elements")
    return met.mapInArrow(tidied(_by_meeting(_join(percent))), "u long, v long"), [family, sets]


def groups(docs: DataFrame, n: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """(id, copy, n_shingles, component): one row per row of docs; component is a
    number that documents of one group share, null for empty sets."""
    base = common.numbered(docs)
    profiles = common.materialise(base.mapInArrow(tidied(_profile(n, lower)), "id long, copy long, n long, node long, cells binary, fine binary"), "profiles")
    size = profiles.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.max("n"), F.lit(1)).alias("most")).first()
    plan = Plan(percent, size["most"])
    per_element = 3.6 * (100 - percent) / (100 + percent)
    buckets = max(4, int(size["all"] * per_element) // BUCKET_SIGNATURES)
    signed = base.select("text").mapInArrow(tidied(_sign(n, lower, plan, min(buckets, common.FANOUT))), "bucket int, nodes binary, signatures binary, whose binary")
    signed = common.in_two_steps(signed, buckets, tidied(_again(buckets)))
    shared = common.materialise(signed.groupBy("bucket").applyInArrow(_shared, "signature long, node long, low long"), "signatures")

    repeats = common.has_repeats(docs)
    pairs = shared.where("low <> node").select(F.col("low").alias("u"), F.col("node").alias("v")).distinct()
    stars = common.materialise(_likely(pairs, profiles, percent), "pairs")
    sets = _sets_of(stars.select(F.explode(F.array("u", "v")).alias("node")).distinct(), base, profiles, n, lower, repeats)
    links = common.materialise(_verify(stars, sets, percent), "links")
    common.discard(stars, sets)
    labels = components(links)
    more, used = _open_links(shared, labels, profiles, lambda wanted: _sets_of(wanted, base, profiles, n, lower, repeats), percent)
    found = common.materialise(more, "links")
    if found.limit(1).count():
        before, labels = labels, components(links.unionByName(found))
        common.discard(before)
    common.discard(shared, links, found, *used)
    return profiles.select("id", "copy", "n", "node").join(labels, "node", "left").select("id", "copy", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component"))


def digest(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    found = groups(docs, n, percent)
    least = found.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    return common.join_apart(found, least, ["component"], "left").select(
        common.public_id(), "n_shingles", F.when(F.coalesce("least", "id") != common.NO_ID, F.coalesce("least", "id")).alias("component_id")
    )


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, with the least doc_id of each group only."""
    found = groups(docs, n, percent)
    alone = found.where("component is null").select("id", "copy")
    best = found.where("component is not null").groupBy("component").agg(F.min(F.struct("id", "copy")).alias("x")).select("x.id", "x.copy")
    rows = common.whole_rows(docs).join(best.unionByName(alone.distinct()), ["id", "copy"], "left_semi")
    if common.has_repeats(docs):
        empty = F.trim(F.regexp_replace(F.coalesce("row.text", F.lit("")), r"[\x09-\x0D]", " ")) == ""
        rows = rows.where(~empty).dropDuplicates(["id", "copy"]).unionByName(rows.where(empty))
    return rows.select("row.*")
