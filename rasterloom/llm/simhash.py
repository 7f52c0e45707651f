"""SimHash near-duplicates by deletion variants.

A fingerprint is cut into segments, fewer than the differing bits that still link, so that of two linked fingerprints one
segment differs by one bit at most: they share that segment with one bit taken out. Every fingerprint is therefore stored under
as many keys as it has bits (a segment without one of its bits); keys are joined for equality and each pair found is verified.

`near_duplicates` is exact: 64 bits in three segments link at up to four differing bits. A key's group of over GROUP fingerprints
is first split by the bits outside the key's segment, cut into one piece more than may differ, of which one is then equal; what is
still large is searched from what is reached to what is left. Pairs are never listed.

`near_copies` is exact too, by similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are
linked. SimHash of 128 bits in eight segments finds most groups: each class is verified with one candidate that shares a
whole segment. It would miss a pair of similarity s whose bits differ too much (each does with probability acos(2s / (1 + s)) / pi), and what connects candidates
doesn't connect links, so an exact search follows: of two similar sets each has one of the other's among the first fifth of its
shingles in any common order (a prefix). Members of a shingle's group that are not connected yet are held against each other by
bounds on their overlap (sizes, places in the prefix, parities of SKETCH bits), and what these allow is verified on the whole sets.
The order puts shingles that a sample has often last; it decides what the search costs, never what it finds.

Fingerprint: a bit is 1 if more than half of the XXH64 values (seed 42) of the word shingles have it. `near_copies` takes hashes
of its own instead (`hashes`, much faster); its second 64 bits come from a bijection of them. Defined results: a text without words
(null, empty) has fingerprint zero, no shingles and links to its like; a text of fewer words than a shingle is one shingle; equal
texts are one class, so that copies are never paired; a null doc_id is never the smallest of others; an empty table has no groups;
other columns of docs are carried along by `deduplicated`, whatever their names (names that begin with two underscores are the
operator's).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE, BITS, SEED = 4, 4, 42
#: First bit of each segment, and the end.
CUTS = (0, 21, 42, 64)
#: A group of one key above this size is linked by search among what is left, not pair by pair.
GROUP = 64
#: Rows of one partition of keys, about; the fewest bits of a piece that a large group is split by.
PART_ROWS, LEAST_PIECE = 2_000_000, 6


#: Of the search by similarity: words of a shingle, least similarity, bits that candidates may differ in, words of 64 bits, first
#: bit of each segment and the end.
WORDS, SIMILAR, WIDE_BITS, WIDE, WIDE_CUTS = 5, 0.8, 30, 2, tuple(range(0, 129, 16))
#: Parities of a set, a multiple of 64; texts and shingles of the sample that orders shingles; entries of one partition of a round.
SKETCH, SAMPLE, OFTEN, ROUND_ROWS = 1024, 20_000, 1 << 16, 500_000
#: Rows of whole groups that are held against each other at once, about; a factor of hashes of words.
AT_ONCE, ODD = 1 << 14, np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each run of lower-cased words, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        spans = [(0, len(text))]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        spans = zip([0, *ends[: n - 1].tolist()], (ends[shingle - 1 :] - 1).tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], SEED) for a, b in spans], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that over half of the numbers have."""
    # bits are counted eight at a time: one byte column per round keeps the unpacked matrix small
    ones = np.zeros(64, np.int64)
    raw = h.view(np.uint8).reshape(-1, 8)
    for lo in range(0, len(h), 65536):
        ones += np.unpackbits(raw[lo : lo + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)), bitorder="little").view(np.uint64)[0])


def lowered(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(common.LOWER).split()


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Of lower-cased words, as an unsigned number."""
    return majority(shingles(words, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, tkey, fp long) of each row of docs (doc_id, text); tkey, the text's xxhash64, tells rows of one doc_id apart."""

    def run(batches):
        for batch in common.sliced(batches):
            fps = [fingerprint(lowered(t), shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tkey"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "tkey", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tkey")).mapInArrow(run, "doc_id long, tkey long, fp long")


def segment_of(bit: int, cuts: tuple) -> int:
    return max(k for k in range(len(cuts) - 1) if cuts[k] <= bit)


def keys_of(classes: DataFrame, names: list[str], cuts: tuple = CUTS, extra: tuple = (), whole: bool = False) -> DataFrame:
    """(key int, names, extra): for each bit, that bit's segment without it, in 22 bits, and above them the number of the bit. No
    segment may reach over two numbers or have over 22 bits. With `whole` only each segment as it is, under its first bit."""
    keys = []
    for k in range(len(cuts) - 1):
        name, lo, n = names[cuts[k] // 64], cuts[k] % 64, cuts[k + 1] - cuts[k]
        part = f"(shiftrightunsigned({name}, {lo}) & {(1 << n) - 1}L)"
        keys += [f"cast({(cuts[k] + j) << 22}L | ({part} & {(1 << n) - 1 if whole else ((1 << n) - 1) & ~(1 << j)}L) as int)" for j in range(1 if whole else n)]
    return classes.select(F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"), *names, *extra)


def first_key(x: np.ndarray, cuts: tuple = CUTS, whole: bool = False) -> np.ndarray:
    """The bit whose key is the first that two fingerprints with difference x (rows of 64-bit numbers) share; cuts[-1] if none."""
    out = np.full(len(x), cuts[-1], np.int64)
    for lo, hi in reversed(list(zip(cuts, cuts[1:]))):
        part = (x[:, lo // 64] >> np.uint64(lo % 64)) & np.uint64((1 << (hi - lo)) - 1)
        n = np.bitwise_count(part)
        out[n == 0] = lo
        if whole:
            continue
        one = n == 1
        out[one] = lo + np.bitwise_count(part[one] - np.uint64(1))
    return out


def linked(a: np.ndarray, b: np.ndarray, p, bits: int, cuts: tuple = CUTS, whole: bool = False) -> np.ndarray:
    """Verified links whose first common key is the one at hand, so that a link is found once."""
    x = a ^ b
    ok = np.bitwise_count(x).sum(axis=1, dtype=np.int64) <= bits
    ok[ok] = first_key(x[ok], cuts, whole) == (p[ok] if isinstance(p, np.ndarray) else p)
    return ok


def forest(fps: np.ndarray, p: int, bits: int, cuts: tuple = CUTS, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions of edges that connect a group as all its links would: each one reached is compared with those not yet reached."""
    left, us, vs = np.arange(len(fps)), [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            f = front.pop()
            ok = linked(fps[left], fps[f][None, :], p, bits, cuts, whole)
            if ok.any():
                got = left[ok]
                us.append(np.full(len(got), f))
                vs.append(got)
                front.extend(got)
                left = left[~ok]
    none = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def neighbours(value: np.ndarray, fps: np.ndarray, p, bits: int, cuts: tuple, group: int, whole: bool = False):
    """Edges among positions of equal value (sorted): all links of small runs, a forest of each large one."""
    begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    size = np.diff(np.append(begin, len(value)))
    few = np.flatnonzero(np.repeat(size, size) <= group)
    sv, sp = value[few], p[few] if isinstance(p, np.ndarray) else p
    for step in range(1, int(size[size <= group].max(initial=1))):
        at = np.flatnonzero(sv[step:] == sv[:-step])
        if not len(at):
            break
        ok = linked(fps[few[at]], fps[few[at + step]], sp[at] if isinstance(sp, np.ndarray) else sp, bits, cuts, whole)
        yield few[at[ok]], few[at[ok] + step]
    for at, n in zip(begin[size > group], size[size > group]):
        yield at, n


def edges_of(keys: np.ndarray, fps: np.ndarray, bits: int, cuts: tuple = CUTS, group: int = GROUP, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions of edges among fingerprints with sorted keys."""
    us, vs = [], []

    def add(u, v):
        us.append(u)
        vs.append(v)

    for a, b in neighbours(keys, fps, keys.astype(np.int64) >> 22, bits, cuts, group, whole):
        if isinstance(a, np.ndarray):
            add(a, b)
            continue
        own, p = fps[a : a + b], int(keys[a]) >> 22
        k = segment_of(p, cuts)
        rest = [i for i in range(cuts[-1]) if not cuts[k] <= i < cuts[k + 1]]
        pieces = np.array_split(rest, bits + 1)
        if len(pieces[-1]) < LEAST_PIECE:
            pieces = [[]]  # too short to tell anything apart
        for piece in pieces:
            value = np.zeros(b, np.uint64)
            for i in piece:
                value = (value << np.uint64(1)) | ((own[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1))
            order = np.argsort(value, kind="stable")
            for u, v in neighbours(value[order], own[order], p, bits, cuts, group, whole):
                if not isinstance(u, np.ndarray):
                    first, second = forest(own[order[u : u + v]], p, bits, cuts, whole)
                    u, v = u + first, u + second
                add(a + order[u], a + order[v])
    none = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def links(classes: DataFrame, bits: int = BITS, names: tuple = ("fp",), cuts: tuple = CUTS, node: str = "fp", whole: bool = False, done: str | None = None) -> DataFrame:
    """(u, v): links of distinct fingerprints, named by node; in a large group of one key, enough of them to keep it connected. With
    `whole` only links of a common segment; with `done`, a column of 0 and 1, only links of which u has 0."""
    if cuts == CUTS and not 0 <= bits <= 4:
        raise ValueError("three segments with one bit taken out find differences of up to 5 bits; the operator promises 4")
    n = classes.count()
    extra = (() if node in names else (node,)) + ((done,) if done else ())
    named, each = (*names, *extra).index(node), len(cuts) - 1 if whole else cuts[-1]
    keys = keys_of(classes, list(names), cuts, extra, whole)
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-each * n // PART_ROWS))
    keys = keys.repartition(parts, "key").sortWithinPartitions("key")

    def run(batches):
        held, last = [], None  # parts of a group that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column("key").to_numpy()
            rows = np.column_stack([batch.column(c).to_numpy().view(np.uint64) for c in (*names, *extra)])
            whole = int(np.searchsorted(k, k[-1], "left"))
            if k[-1] != last:
                held.append((k[:whole], rows[:whole]))
                yield from found(held)
                held, last = [], k[-1]
                k, rows = k[whole:], rows[whole:]
            held.append((k, rows))
        yield from found(held)

    def found(held):
        if sum(len(k) for k, _ in held) > 1:
            k, rows = (np.concatenate(x) for x in zip(*held))
            if done:
                begin, size = grouped_by(k)
                some = np.repeat(np.minimum.reduceat(rows[:, -1], begin) == 0, size)
                k, rows = k[some], rows[some]
            if not len(k):
                return
            u, v = edges_of(k, np.ascontiguousarray(rows[:, : len(names)]), bits, cuts, whole=whole)
            name = rows[:, named].view(np.int64)
            if done:
                settled = rows[:, -1] != 0
                turn = settled[u] | ~settled[v] & (name[u] < name[v])
                u, v = np.where(turn, v, u), np.where(turn, u, v)
                u, v = u[~settled[u]], v[~settled[u]]
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(name[u]), pa.array(name[v])], names=["u", "v"])

    return keys.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, tkey, fp, component_id, kept): component_id is the smallest doc_id that links reach from the row, its own
    included; kept marks the rows of the one document that stays for its component: smallest doc_id, then smallest tkey."""
    found = common.written(fingerprints(docs, shingle))
    me = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")
    classes = common.written(found.groupBy("fp").agg(F.min(me).alias("least")))
    roots = components(links(classes, bits))
    tied = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = tied.groupBy("root").agg(F.min("least").alias("first"))
    by_class = tied.join(smallest, "root").select("fp", "first")
    return found.join(by_class, "fp").select("doc_id", "tkey", "fp", F.col("first.doc_id").alias("component_id"), (F.col("first") == me).alias("kept"))


def hashes(column, shingle: int) -> list[np.ndarray]:
    """64-bit hashes of the shingles of each row of a column of text, repeats included, by whole slices. Not XXH64: near_copies only
    asks which shingles are equal."""
    data, ends = common.bytes_of(column)
    starts, stops, first = common.words_of(data, ends)
    h, n = common.WordHash(lower=True)(data, starts, stops), np.diff(first)
    out, acc = [np.zeros(0, np.uint64)] * len(n), h
    for k in range(1, shingle):  # a row of fewer words is one shingle
        for row in np.flatnonzero(n == k).tolist():
            out[row] = common.mixed(acc[first[row] : first[row] + 1])
        acc = acc[:-1] * ODD + h[k:]
    acc = common.mixed(acc)
    for row in np.flatnonzero(n >= shingle).tolist():
        out[row] = acc[first[row] : first[row + 1] - shingle + 1]
    return out


def shingle_sets(ids: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(id, h): the distinct shingles of the texts (id, text) that ids asks for."""

    def run(batches):
        for batch in common.sliced(batches):
            sets = [np.unique(h).view(np.int64) for h in hashes(batch.column("text"), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "h"])

    # by shuffles at every size: nothing that grows with the table is broadcast
    return texts.join(ids.hint("merge"), "id", "left_semi").dropDuplicates(["id"]).mapInArrow(run, "id long, h array<long>")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those pairs (u, v) whose sets have a Jaccard similarity of `least` or more; two empty sets are alike."""
    own = lambda c: sets.select(F.col("id").alias(c), F.col("h").alias(f"h{c}")).hint("merge")
    both = pairs.join(own("u"), "u").join(own("v"), "v")
    shared = F.size(F.array_intersect("hu", "hv"))
    return both.filter(shared >= F.lit(least) * (F.size("hu") + F.size("hv") - shared)).select("u", "v")


def frequent(texts: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that a sample of about SAMPLE distinct texts (id, text) has often, the rarest first."""
    each = max(1, texts.count() // SAMPLE)

    def run(batches):
        for batch in common.sliced(batches):
            sets = [np.unique(h) for h in hashes(batch.column("text"), shingle)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    some = texts.filter(F.pmod("id", F.lit(each)) == 0).dropDuplicates(["id"]).select("text").mapInArrow(run, "h long")
    top = some.groupBy("h").count().filter("count > 1").orderBy(F.desc("count"), "h").limit(OFTEN).toPandas()
    return top["h"].to_numpy(np.int64)[::-1].view(np.uint64).copy()


def signatures(texts: DataFrame, often: np.ndarray, shingle: int, least: float) -> DataFrame:
    """(id, f0, f1, n, bits, prefix) of texts (id, text): fingerprint, size and parities of the set of shingles, and as many of them,
    in the order of values with those of `often` last, as a set of similarity `least` must share one of. A set of none has 0."""
    values, rank = np.sort(often), np.argsort(often)

    def first(h: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.zeros(1, np.int64)
        size = len(h) - ceil(least * len(h)) + 1
        if len(values):
            at = np.minimum(np.searchsorted(values, h), len(values) - 1)
            known = values[at] == h
            h = np.concatenate([h[~known], h[known][np.argsort(rank[at[known]])]])
        return h[:size].view(np.int64)

    def run(batches):
        for batch in common.sliced(batches):
            rows = hashes(batch.column("text"), shingle)
            fps = [[majority(common.mixed(h ^ np.uint64(k)) if k else h) for h in rows] for k in range(WIDE)]
            sets = [np.unique(h) for h in rows]
            bits = [np.packbits(np.bincount((h % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).tobytes() for h in sets]
            made = [*(pa.array(np.array(f, np.uint64).view(np.int64)) for f in fps), pa.array([len(h) for h in sets], pa.int32()), pa.array(bits, pa.binary()), pa.array([first(h) for h in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], names=["id", "f0", "f1", "n", "bits", "prefix"])

    return texts.select("id", "text").mapInArrow(run, "id long, f0 long, f1 long, n int, bits binary, prefix array<long>")


def ceil(x):
    """Rounded up, but for what products of fractions are off by; never above what the comparison of whole sets asks for."""
    return np.ceil(x - 1e-6).astype(np.int64) if isinstance(x, np.ndarray) else int(np.ceil(x - 1e-6))


def whole_groups(batches):
    """Tables that hold all rows of each of their values of h; rows come sorted by it."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1], "left"))
        if held and h[-1] != last:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        elif not held and cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
            batch = batch.slice(cut)
        held.append(batch)
        last = h[-1]
    if held:
        yield pa.Table.from_batches(held)


def grouped_by(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of each run of equal values."""
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return begin, np.diff(np.append(begin, len(h)))


def shared_groups(batches):
    """Tables of whole groups of one h, by h, n and id, of all rows of a partition in any order. Most shingles are in one text alone:
    they go before anything but their h is sorted."""
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held)
    h = t.column("h").to_numpy()
    order = np.argsort(h)
    size = grouped_by(h[order])[1] if len(h) else np.zeros(0, np.int64)
    t = t.take(pa.array(order[np.repeat(size, size) > 1]))
    del held, h, order, size
    t = t.take(pa.array(np.lexsort([t.column(c).to_numpy() for c in ("id", "n", "h")])))
    h = t.column("h").to_numpy()
    lo = 0
    while lo < len(h):
        hi = int(np.searchsorted(h, h[min(len(h), lo + AT_ONCE) - 1], "right"))
        yield t.slice(lo, hi - lo)
        lo = hi


def fitting(h, n, pos, bits, least: float, low: int = 1, high: int | None = None, skip=None):
    """Pairs of places in the same group, from low to below high apart, that may have the similarity. Rows are sorted by h, then n;
    bits (or None) are rows of 64-bit numbers; skip tells which pairs need no look."""
    begin, size = grouped_by(h)
    end, at, step = np.repeat(begin + size, size), np.arange(len(h)), low
    while high is None or step < high:
        at = at[at + step < end[at]]
        at = at[n[at] >= ceil(least * n[at + step])]  # the next ones are larger still
        if not len(at):
            return
        i = at if skip is None else at[~skip(at, at + step)]
        need = ceil(least / (1 + least) * (n[i] + n[i + step]))
        fits = np.minimum(n[i] - pos[i], n[i + step] - pos[i + step]) >= need
        i, need = i[fits], need[fits]
        if bits is not None:  # each shingle that only one of the sets has turns one parity over
            i = i[np.bitwise_count(bits[i] ^ bits[i + step]).sum(axis=1, dtype=np.int64) <= n[i] + n[i + step] - 2 * need]
        if len(i):
            yield i, i + step
        step += 1


def columns(t: pa.Table) -> tuple:
    """h, id, n, pos and, where there are any, bits of entries."""
    h, ids, n, pos = (t.column(c).to_numpy() for c in ("h", "id", "n", "pos"))
    bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(h), -1) if "bits" in t.column_names else None
    return h, ids, n.astype(np.int64), pos.astype(np.int64), bits


def partnered(entries: DataFrame, least: float, n_rows: int, per: int) -> DataFrame:
    """The entries (h, id, n, pos, and bits) that have a fitting partner in their group, without bits."""
    parts = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // per))

    def run(batches):
        for t in shared_groups(batches):
            h, _, n, pos, bits = columns(t)
            keep = np.zeros(len(h), bool)
            for i, j in fitting(h, n, pos, bits, least, skip=lambda i, j, keep=keep: keep[i] & keep[j]):
                keep[i] = keep[j] = True
            yield from t.select(["h", "id", "n", "pos"]).filter(pa.array(keep)).to_batches()

    return entries.repartition(parts, "h").mapInArrow(run, "h long, id long, n int, pos int")


def apart(entries: DataFrame, info: DataFrame, roots: DataFrame, low: int, high: int, least: float) -> DataFrame:
    """(u, v, h, id, n, pos): pairs to verify, from low to below high places apart in a group, and (u null) the entries of groups that
    reach further and are not connected. info is (id, bits)."""
    rooted = info.join(roots.select(F.col("node").alias("id"), "root").hint("merge"), "id", "left").select("id", "bits", F.coalesce("root", "id").alias("root"))
    parts = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // ROUND_ROWS))
    full = entries.join(rooted.hint("merge"), "id").repartition(parts, "h").sortWithinPartitions("h", "n", "id")

    def run(batches):
        for t in whole_groups(batches):
            h, root = t.column("h").to_numpy(), t.column("root").to_numpy()
            begin, size = grouped_by(h)
            mixed = np.maximum.reduceat(root, begin) != np.minimum.reduceat(root, begin)
            t = t.filter(pa.array(np.repeat(mixed & (size > low), size)))
            if not t.num_rows:
                continue
            h, ids, n, pos, bits = columns(t)
            root, size = t.column("root").to_numpy(), grouped_by(h)[1]
            pairs = [np.empty((0, 2), np.int64)]
            for i, j in fitting(h, n, pos, bits, least, low, high, lambda i, j, root=root: root[i] == root[j]):
                pairs.append(np.unique(np.sort(np.column_stack([ids[i], ids[j]]), axis=1)[:, ::-1], axis=0))
            pairs = np.unique(np.concatenate(pairs), axis=0)
            if len(pairs):
                none = [pa.nulls(len(pairs), k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *none], names=["u", "v", "h", "id", "n", "pos"])
            far = t.filter(pa.array(np.repeat(size > high, size))).select(["h", "id", "n", "pos"])
            for batch in far.to_batches():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(batch.num_rows, pa.int64()) for _ in range(2)), *batch.columns], names=["u", "v", "h", "id", "n", "pos"])

    return full.mapInArrow(run, "u long, v long, h long, id long, n int, pos int")


def candidates(classes: DataFrame, whole: bool = False) -> DataFrame:
    """(u, v): one candidate by SimHash, v, of each class u that has any. In a group of near copies each of 128 keys connects all of
    them, so those that share a whole segment (eight keys) come first, and the others are asked only for whom that leaves alone; with
    `whole` the others are not asked."""
    wide = (WIDE_BITS, ("f0", "f1"), WIDE_CUTS, "id")
    near = links(classes, *wide, True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = common.written(near.groupBy("u").agg(F.min("v").alias("v")))
    if whole:
        return near
    marked = classes.select("id", "f0", "f1").join(near.select(F.col("u").alias("id"), F.lit(1).cast("long").alias("one")).hint("merge"), "id", "left")
    marked = common.written(marked.select("id", "f0", "f1", F.coalesce("one", F.lit(0).cast("long")).alias("done")))
    todo = common.written(near.unionAll(links(marked, *wide, False, "done").groupBy("u").agg(F.min("v").alias("v"))))
    common.removed(near, marked)
    return todo


def copies(classes: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(node, root) by links of similarity `least` or more, of classes as signatures gives them, once for each text; removes classes.

    First each class is verified with one of its candidates by SimHash. What is left apart is searched by shared prefixes, in each
    group from neighbours to ever more distant members; what got connected by then needs no verifying, so that large groups of
    copies cost little, and pairs that the bounds rule out are never listed.
    """
    entries = classes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0)).alias("n")).first()["n"]
    index = classes.select("id", "n", F.posexplode("prefix").alias("pos", "h")).select("h", "id", "n", "pos")
    sized = common.written(partnered(index, least, entries, PART_ROWS))
    bits = lambda of: classes.select("id", "bits").join(of.select("id").distinct().hint("merge"), "id", "left_semi")
    left = common.written(partnered(sized.join(bits(sized).hint("merge"), "id"), least, sized.count(), ROUND_ROWS))
    info = common.written(bits(left))
    common.removed(sized)
    # 120 more keys for each class would cost more than the search below takes for the pairs that only they find
    todo = candidates(classes, whole=True)
    common.removed(classes)
    ids = todo.select(F.explode(F.array("u", "v")).alias("id")).unionAll(left.select("id")).distinct()
    sets = common.written(shingle_sets(ids, texts, shingle))
    roots = common.written(components(similar(todo, sets, least)))
    common.removed(todo)
    low, high = 1, 2
    while left.take(1):
        step = common.written(apart(left, info, roots, low, high, least))
        pairs = step.filter("u IS NOT NULL").select("u", "v").distinct()
        if pairs.take(1):
            # what hangs together already counts as its links to the root
            edges = similar(pairs, sets, least).unionAll(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
            roots = common.written(components(edges))
        left = common.written(step.filter("u IS NULL").select("h", "id", "n", "pos"))
        common.removed(step)
        low, high = high, max(9, 4 * high)
    common.removed(sets, info)
    return roots


def near_copies(docs: DataFrame, shingle: int = WORDS, least: float = SIMILAR) -> DataFrame:
    """(doc_id, tkey, component_id, kept) as near_duplicates gives them, by similarity. Texts are named by 60 bits of their SHA-256."""
    name = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 15), 16, 10).cast("long")
    texts = docs.select(name.alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    classes = common.written(signatures(texts, frequent(texts, shingle), shingle, least).dropDuplicates(["id"]))
    rows = common.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), name.alias("id")))
    me = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")
    roots = copies(classes, texts, shingle, least)
    classes = rows.groupBy("id").agg(F.min(me).alias("least")).join(roots, F.col("id") == roots.node, "left")
    tied = common.written(classes.select("id", "least", F.coalesce("root", "id").alias("root")))
    smallest = common.written(tied.groupBy("root").agg(F.min("least").alias("first")))
    by_class = common.written(tied.join(smallest.hint("merge"), "root").select("id", "first"))
    common.removed(tied, smallest)
    return rows.join(by_class.hint("merge"), "id").select("doc_id", "tkey", F.col("first.doc_id").alias("component_id"), (F.col("first") == me).alias("kept"))


def deduplicated(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """docs with one row of each component of what near_duplicates or near_copies gave: the kept one, once where it is repeated."""
    stay = grouped.filter("kept").select(F.col("doc_id").alias("__id"), F.col("tkey").alias("__key")).distinct().hint("merge")
    keyed = docs.withColumn("__tkey", F.xxhash64("text"))
    kept = keyed.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__tkey") == F.col("__key")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__tkey"]).drop("__tkey")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
