"""N-gram Jaccard join: a token-group matrix finds every pair of documents whose shingle sets are similar.

Tokens are 64-bit hashes of five-word shingles; documents with equal sets are one class, and one document stands for
it. The join is exact (but for collisions of 64-bit hashes) by these steps:

1. Groups: each class names its SKETCH smallest tokens and goes to the group of the class that leads most of them, the
   one whose tokens are held by most classes. Where it leads half of them, both are compared, so that most near copies are
   connected by one comparison each.
2. Tokens have one order for all classes: by hash, but those of many groups last. Of similar sets the first
   n - ceil(t * n) + NEED tokens share at least NEED, so only these prefixes are indexed. Which tokens count as
   frequent changes the work, not the result.
3. The token-group matrix holds the union of each group's prefix tokens. It is dealt to tasks by token, as packed arrays;
   a task tells of each class how many of its tokens each group holds. The sum bounds the overlap with every member, and
   only groups that reach the bound, and are not connected with the class already, are opened: blocks of classes are
   compared with blocks of members by their whole texts, and a block returns no more links than connect it.
4. Components of all links are the result.

The classes of a group of more than LARGE don't ask by tokens (its tokens are sent once by each task, however many classes
hold them): all others ask it, two such groups are compared block by block if their unions meet, and so is one with itself
unless it is connected.

Defined results: null and empty texts, and texts of white space, have no shingles and are their own component; texts
of fewer words than a shingle have one; repeated rows and ids give one row each (equal texts are one class); rows with a
null key link as all others do, and have a null component only if no row of it has a key; very long texts are read
whole; an empty table gives no rows; further columns are ignored. Nothing is expanded into all pairs of a group of copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import BATCH_BYTES, components, cut, map_arrow, release, small, written

SIZE, PERCENT = 5, 75
#: Tokens that prefixes of similar sets share at least (where the sets are large enough).
NEED = 6
#: Smallest tokens by which groups are formed, and rounds of comparisons with leaders; one connects nearly all that later ones would.
SKETCH, ROUNDS = 8, 1
#: A token of more groups counts as frequent; so many tokens may at most.
FREQUENT, MOST_FREQUENT = 20, 1 << 20
#: Frequent tokens are looked for in prefixes by hash, and then within so many places of those found.
NEAR = 12
#: Tokens on a side of a block on average, members that are compared at once, members that one copy of a leader's text meets, and classes of a large group.
SIDE, ONCE, MEMBERS, LARGE = 1 << 18, 512, 512, 1 << 16
#: Parts that tokens are dealt to at least, tokens of a part on average at most, and tokens that a task holds before it sends them.
PARTS, PART, HELD = 256, 1 << 20, 1 << 18
#: Bytes of text that are read at once.
SLICE = 1 << 19

ODD = np.random.default_rng(20240229).integers(1, 1 << 63, 600, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BYTE = np.where(SPACE, np.uint64(0), ODD[[b + 32 if 65 <= b <= 90 else b for b in range(256)]])
STEP = ODD[300]
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
POWERS: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(POWERS.get("up", ())) < n:
        for name, base in (("up", STEP), ("down", BACK)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            POWERS[name] = np.multiply.accumulate(steps)
    return POWERS["up"], POWERS["down"]


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    """Of each text (data between two offsets) the hashes of its shingles, in order."""
    n, texts = len(data), len(offsets) - 1
    if not n:
        return [np.zeros(0, np.uint64)] * texts
    space = SPACE[data]
    before, behind = np.append(True, space[:-1]), np.append(space[1:], True)
    filled = offsets[:-1] < offsets[1:]
    before[offsets[:-1][filled]] = True
    behind[offsets[1:][filled] - 1] = True
    begin, end = np.flatnonzero(~space & before), np.flatnonzero(~space & behind) + 1
    up, down = powers(n + 1)
    total = np.append(np.uint64(0), np.cumsum(BYTE[data] * up[:n], dtype=np.uint64))
    word = mixed((total[end] - total[begin]) * down[begin])
    first = np.searchsorted(begin, offsets)
    whole = np.full(max(0, len(word) - size + 1), ODD[400 + size])
    for k in range(size):
        whole += word[k : k + len(whole)] * ODD[500 + k]
    whole = mixed(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(whole[a : b - size + 1])
        elif b > a:
            out.append(mixed(ODD[400 + b - a] + (word[a:b] * ODD[500 : 500 + b - a]).sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(whole[:0])
    return out


def slices(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(number of the first text, shingles of each) of a column of texts, a slice of bytes at a time."""
    release()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, where, buffer = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    k = 0
    while k < len(column):
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SLICE, side="right")) - 1)
        own = offsets[k : stop + 1]
        yield k, shingles(data[own[0] : own[-1]], own - own[0])
        k = stop


def class_of(tokens: np.ndarray) -> int:
    """A hash of a set of tokens, as a signed number."""
    own = mixed(tokens ^ ODD[450]).sum(dtype=np.uint64, keepdims=True) + np.array([len(tokens)], np.uint64) * ODD[451]
    return int(mixed(own).view(np.int64)[0])


def among(tokens: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which tokens are in a sorted array."""
    if not len(held) or not len(tokens):
        return np.zeros(len(tokens), bool)
    at = np.searchsorted(held, tokens)
    return held[np.minimum(at, len(held) - 1)] == tokens


def prefix(tokens: np.ndarray, frequent: np.ndarray, percent: int, need: int) -> np.ndarray:
    """The first tokens of a sorted set in the common order, as many as similar sets can't miss each other in."""
    n = len(tokens)
    size = min(n, n - -(-percent * n // 100) + need)
    rare = tokens[~among(tokens, frequent)]
    if len(rare) >= size:
        return rare[:size]
    return np.concatenate([rare, tokens[among(tokens, frequent)][: size - len(rare)]])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def describe(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, h, n, cls, least): a hash of each document's key and text, its set's size, class and smallest tokens."""
    kind = dict(docs.dtypes)[key]

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, classes, least = [], [], []
        for _, texts in slices(batch.column(2)):
            for s in texts:
                s = np.unique(s)
                sizes.append(len(s))
                classes.append(class_of(s) if len(s) else None)
                least.append(s[:SKETCH].view(np.int64))
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(least, pa.list_(pa.int64()))], names=[key, "h", "n", "cls", "least"])

    return map_arrow(docs.select(key, hash_of(key, text).alias("h"), text), over, f"{key} {kind}, h long, n long, cls long, least array<long>")


def hash_of(key: str, text: str) -> Column:
    """One number that names a document: rows with the same key and text are the same one."""
    return F.xxhash64(key, F.coalesce(F.col(text), F.lit("")))


def numbered(classes: DataFrame) -> DataFrame:
    """The rows, written, with dense numbers `num` from 0 on; as many counts come to the driver as there are files."""
    made = written(classes.withColumn("_at", F.monotonically_increasing_id()), "classes")
    file, begin, offsets = F.shiftright("_at", 33), 0, []
    for p, c in sorted(map(tuple, made.groupBy(file.alias("p")).count().collect())):
        offsets.append((p, begin))
        begin += c
    told = made.sparkSession.createDataFrame(offsets, "_p long, _begin long")
    return made.join(F.broadcast(told), file == F.col("_p")).withColumn("num", F.col("_begin") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_p", "_begin")


def with_texts(wanted: DataFrame, docs: DataFrame, text: str, key: str, columns: list[str]) -> DataFrame:
    """The columns of a written table (h, ...) with `_text`, the text of the document that h names."""
    found = docs.select(hash_of(key, text).alias("h"), F.col(text).alias("_text"))
    return found.join(small(wanted, 24 + 8 * len(columns)), "h").select(*columns, "_text")


# -- groups -----------------------------------------------------------------------------------------------------------


def alike(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of sizes a and b can be similar."""
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def of_several(rows: DataFrame, name: str) -> DataFrame:
    """The rows (token, num, n, grp) of tokens that several groups have, as a written table."""
    several = rows.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("token")
    return written(rows.join(several, "token"), name)


def leaders(rows: DataFrame, order: Column, percent: int) -> DataFrame:
    """(a, b, strong): each class with the leader of most of its tokens in another component, two at least; strong: half of them, and sizes are alike. Leaders come first by an order."""
    lead = rows.groupBy("token").agg(F.max(F.struct(order.alias("o"), "num", "grp", "n")).alias("l"))
    led = rows.join(lead.select("token", F.col("l.num").alias("lead"), F.col("l.grp").alias("other"), F.col("l.n").alias("m")), "token").where("grp <> other")
    strong = alike(F.col("n"), F.col("m"), percent) & (F.col("c") * 2 >= F.least("n", "m", F.lit(SKETCH)))
    led = led.groupBy("num", "n", "lead", "m").agg(F.count("*").alias("c")).withColumn("strong", strong).where("strong or c >= 2")
    best = led.groupBy("num").agg(F.max(F.struct("strong", "c", "lead")).alias("b"))
    return written(best.select(F.col("num").alias("a"), F.col("b.lead").alias("b"), F.col("b.strong").alias("strong")), "led")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, key: str, percent: int) -> DataFrame:
    """The pairs (class a, leader b) whose sets are similar, decided on whole texts. A leader's text goes to its members', MEMBERS of them at a time."""
    spread = small(written(pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).alias("wide")), "spread"), 24)
    members = pairs.join(spread, "b").select(F.col("a").alias("num"), "b", F.pmod(F.xxhash64("a"), F.col("wide")).alias("i"), F.lit(1).alias("side"))
    lead = spread.select(F.col("b").alias("num"), "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1)).alias("i"), F.lit(0).alias("side"))
    wanted = written(members.unionByName(lead).join(classes.select("num", "h"), "num"), "wanted")
    dealt = with_texts(wanted, docs, text, key, ["num", "b", "i", "side"]).repartition("b", "i").sortWithinPartitions("b", "i", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = None, None
        for whole in batches:
            for batch in cut(whole, BATCH_BYTES):
                out = ([], [])
                sets = (np.unique(s) for _, some in slices(batch.column(4)) for s in some)
                for num, b, i, side, s in zip(*(batch.column(k).to_pylist() for k in range(4)), sets, strict=True):
                    if side == 0:
                        block, own = (b, i), s
                    elif block == (b, i):
                        met = int(among(s, own).sum())
                        if 100 * met >= percent * (len(s) + len(own) - met):
                            out[0].append(num)
                            out[1].append(b)
                yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    return written(dealt.mapInArrow(compare, "a long, b long"), "linked")


def form_groups(classes: DataFrame, docs: DataFrame, text: str, key: str, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(num, n, h, hub, grp) of the classes, written, and the links found. hub names the class's group; grp, what it is connected with so far."""
    rows = of_several(classes.select(F.explode("least").alias("token"), "num", "n", F.col("num").alias("grp")), "sketch")
    held = rows.groupBy("token").agg(F.count("*").alias("c"))
    weight = rows.join(held, "token").groupBy("num").agg(F.sum("c").alias("weight"))
    rows = written(rows.join(weight, "num"), "weighed")
    links = groups = hubs = None
    for k in range(ROUNDS):
        led = leaders(rows, F.xxhash64("num", F.lit(k)) if k else F.col("weight"), percent)
        hubs = led.select(F.col("a").alias("num"), F.col("b").alias("hub")) if hubs is None else hubs
        found = verified(led.where("strong").select("a", "b"), classes, docs, text, key, percent)
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        groups = components(links, "groups").select(F.col("node").alias("num"), F.col("component").alias("grp"))
        rows = of_several(rows.drop("grp").join(groups, "num", "left").withColumn("grp", F.coalesce("grp", "num")), "grouped")
    own = classes.select("num", "n", "h").join(hubs, "num", "left").withColumn("hub", F.coalesce("hub", "num"))
    own = own.withColumn("grp", F.col("num")) if groups is None else own.join(groups, "num", "left").withColumn("grp", F.coalesce("grp", "num"))
    return written(own, "grouped"), links


# -- tokens, dealt to parts ---------------------------------------------------------------------------------------------


def parts_for(tokens: int) -> int:
    """A power of two."""
    return max(PARTS, 1 << max(0, -(-tokens // PART) - 1).bit_length())


def packed(made: Iterator[tuple], parts: int) -> Iterator[pa.RecordBatch]:
    """(part, blob) of (tokens, numbers beside them): the tokens of a part, then each number repeated for its tokens. Equal rows of what is held together are sent once."""
    held: list[tuple] = []
    size = 0

    def sent() -> pa.RecordBatch:
        tokens = np.concatenate([h[0] for h in held])
        many = [len(h[0]) for h in held]
        beside = [np.repeat(np.array(column, np.uint64), many) for column in list(zip(*held, strict=True))[1:]]
        part = tokens & np.uint64(parts - 1)
        order = np.lexsort((*reversed(beside), tokens, part))
        columns = [c[order] for c in (part, tokens, *beside)]
        new = np.zeros(len(tokens), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        if not beside:
            new[:] = True
        part, *columns = (c[new] for c in columns)
        first = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1)))
        small_enough = not beside or max(c.max() for c in columns[1:]) < 1 << 32
        columns = [columns[0], *(c.astype(np.uint32) if small_enough else c for c in columns[1:])]
        blobs = [(b"\0" if small_enough else b"\1") + b"".join(c[a:z].tobytes() for c in columns) for a, z in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True)]
        return pa.record_batch([pa.array(part[first].astype(np.int64)), pa.array(blobs, pa.binary())], names=["part", "blob"])

    for row in made:
        if len(row[0]):
            held.append(row)
            size += len(row[0])
            if size > HELD:
                yield sent()
                held, size = [], 0
    if held:
        yield sent()


def opened_blob(blob: bytes, beside: int) -> list[np.ndarray]:
    """The columns of a blob of `packed`."""
    kind = np.dtype("<u8" if blob[:1] == b"\1" else "<u4")
    n = (len(blob) - 1) // (8 + beside * kind.itemsize)
    out, at = [np.frombuffer(blob, "<u8", n, 1)], 1 + 8 * n
    for _ in range(beside):
        out.append(np.frombuffer(blob, kind, n, at).astype(np.uint64))
        at += n * kind.itemsize
    return out


def by_part(dealt: DataFrame, beside: int, function: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What the function makes of the columns of each part."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                held.clear()
                yield from function(*columns)

        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != part:
                    yield from done()
                    part = p
                held.append(opened_blob(blob.as_py(), beside))
        yield from done()

    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(over, schema)


def each_set(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    """(other columns, shingles in order) of each row; the text is the last column."""
    for whole in batches:
        for batch in cut(whole, BATCH_BYTES):
            sets = (s for _, some in slices(batch.column(columns)) for s in some)
            yield from zip(*(batch.column(k).to_pylist() for k in range(columns)), sets, strict=True)


def most_frequent(dealt: DataFrame, frequent: int) -> np.ndarray:
    """The tokens dealt more than so many times, the most frequent ones if there are too many; sorted."""

    def count(tokens: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, c = np.unique(tokens, return_counts=True)
        keep = c > frequent
        yield pa.record_batch([signed(found[keep]), pa.array(c[keep])], names=["token", "c"])

    counted = written(by_part(dealt, 0, count, "token long, c long"), "frequent")
    got = counted.orderBy(F.desc("c"), "token").limit(MOST_FREQUENT).select("token").toArrow()["token"].to_numpy()
    return np.sort(got.astype(np.int64).view(np.uint64))


def find_frequent(classes: DataFrame, docs: DataFrame, text: str, key: str, frequent: int, percent: int, need: int, parts: int) -> np.ndarray:
    """Tokens of many groups, each seen by one class: those in prefixes by hash, and of the tokens near them in texts (passages are frequent as a whole)."""
    firsts = written(classes.where("num = grp").select("h"), "firsts")
    none = np.zeros(0, np.uint64)

    def by_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(((prefix(np.unique(s), none, percent, need),) for (s,) in each_set(batches, 0)), parts)

    seeds = most_frequent(with_texts(firsts, docs, text, key, []).mapInArrow(by_hash, "part long, blob binary"), frequent)
    if not len(seeds):
        return seeds
    held = docs.sparkSession.sparkContext.broadcast(seeds)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for (s,) in each_set(batches, 0):
                hit = among(s, held.value)
                if hit.any():
                    reach = np.zeros(len(s) + 2 * NEAR + 1, np.int32)
                    at = np.flatnonzero(hit)
                    np.add.at(reach, at, 1)
                    np.add.at(reach, at + 2 * NEAR + 1, -1)
                    yield (np.unique(s[np.cumsum(reach)[NEAR : NEAR + len(s)] > 0]),)

        yield from packed(found(), parts)

    return most_frequent(with_texts(firsts, docs, text, key, []).mapInArrow(near, "part long, blob binary"), frequent)


def needed(a: Column, b: Column, percent: int, need: int) -> Column:
    """Prefix tokens that sets of sizes a and b share if they are similar."""
    return F.least(F.lit(need), F.ceil(F.least(a, b) * percent / 100))


def asked(tokens: np.ndarray, hubs: np.ndarray, refs: np.ndarray, sizes: np.ndarray, percent: int, need: int) -> Iterator[pa.RecordBatch]:
    """(num, hub, g, c, tiny): in c of these tokens the class num of the group hub meets classes of alike size in the group g; tiny: one of them has too few tokens to share `need`.

    A ref is 2 * (num + 1), plus 1 if the class asks its own group too; 0 stands for all classes of a large group, then num is
    null. Of two groups that meet, the smaller one's classes ask; those of a large one never do, but two of these meet as groups.
    """
    order = np.lexsort((refs, hubs, tokens))
    columns = [x[order].astype(np.int64) for x in (tokens, hubs, refs, sizes)]
    start = lambda *some: np.append(True, np.any([x[1:] != x[:-1] for x in some], axis=0))[: len(some[0])]
    new = start(*columns[:3])
    tokens, hubs, refs, sizes = (x[new] for x in columns)
    first = np.flatnonzero(start(tokens))
    last = np.append(first[1:], len(tokens)) - 1
    several = np.repeat((hubs[first] != hubs[last]) | (refs[first] != refs[last]) & (refs[first] & 1 > 0), last - first + 1) if len(first) else new
    tokens, hubs, refs, sizes = (x[several] for x in (tokens, hubs, refs, sizes))
    if not len(tokens):
        return
    head = start(tokens, hubs)
    cell, at = np.cumsum(head) - 1, np.flatnonzero(head)  # of each row, its place among the pairs (token, group)
    own, large, held, token = hubs[head], refs[head] == 0, np.bincount(cell), tokens[head]
    low, high = np.where(large, 0, np.minimum.reduceat(sizes, at)), np.where(large, 1 << 40, np.maximum.reduceat(sizes, at))
    begin = np.maximum.accumulate(np.where(start(token), np.arange(len(token)), 0))
    end = np.append(np.flatnonzero(start(token))[1:], len(token))[np.cumsum(start(token)) - 1]
    reach = (end - begin)[cell]
    total, k = np.append(0, np.cumsum(reach)), 0
    while k < len(reach):
        stop = max(k + 1, int(np.searchsorted(total, total[k] + HELD, "right")) - 1)
        many = reach[k:stop]
        mine = np.repeat(np.arange(k, stop), many)
        to = np.repeat(begin[cell[k:stop]] - np.cumsum(many) + many, many) + np.arange(many.sum())
        ask, same, later = refs[mine] > 0, own[to] == hubs[mine], own[to] > hubs[mine]
        alike = (high[to] * 100 >= sizes[mine] * percent) & (sizes[mine] * 100 >= low[to] * percent)
        keep = np.where(same, ask & alike & (refs[mine] & 1 > 0) & (held[to] > 1), np.where(ask, alike & (large[to] | later), large[to] & later))
        mine, to = mine[keep], to[keep]
        ref, hub, g, tiny = refs[mine], hubs[mine], own[to], np.minimum(sizes[mine], low[to]) * percent <= 100 * (need - 1)
        order = np.lexsort((g, hub, ref))
        ref, hub, g, tiny = ref[order], hub[order], g[order], tiny[order]
        new = np.flatnonzero(start(ref, hub, g))
        if len(new):
            told = [pa.array(ref[new] // 2 - 1, mask=ref[new] == 0), pa.array(hub[new]), pa.array(g[new]), pa.array(np.diff(np.append(new, len(ref)))), pa.array(np.logical_or.reduceat(tiny, new))]
            yield pa.record_batch(told, names=["num", "hub", "g", "c", "tiny"])
        k = stop


def questions(classes: DataFrame, docs: DataFrame, text: str, key: str, frequent: np.ndarray, percent: int, need: int, parts: int) -> DataFrame:
    """(num, hub, g): the groups that each class must be compared with; a null num stands for all classes of a group."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)
    sizes = classes.groupBy("hub").agg(F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("grp").alias("lo"), F.max("grp").alias("hi"))
    sizes = written(sizes, "sizes")
    large = F.col("size") > LARGE
    special = written(sizes.where(large | (F.col("lo") < F.col("hi"))).select("hub", large.alias("large"), (F.col("lo") < F.col("hi")).alias("mixed")), "special")
    ref = F.when(F.col("large"), 0).otherwise((F.col("num") + 1) * 2 + F.coalesce(F.col("mixed"), F.lit(False)).cast("long"))
    own_size = F.when(F.col("large"), 0).otherwise(F.col("n"))
    wanted = written(classes.join(small(special, 24), "hub", "left").select("h", "hub", ref.alias("ref"), own_size.alias("size")), "indexed")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(((prefix(np.unique(s), held.value, percent, need), hub, ref, size) for hub, ref, size, s in each_set(batches, 3)), parts)

    dealt = with_texts(wanted, docs, text, key, ["hub", "ref", "size"]).mapInArrow(over, "part long, blob binary")
    met = by_part(dealt, 3, lambda *columns: asked(*columns, percent, need), "num long, hub long, g long, c long, tiny boolean")
    met = met.groupBy("num", "hub", "g").agg(F.sum("c").alias("c"), F.max("tiny").alias("tiny"))
    met = written(met.where((F.col("c") >= need) | F.col("tiny") | F.col("num").isNull()), "met")
    own, g = sizes.select("hub", "least", "most"), sizes.select(F.col("hub").alias("g"), F.col("least").alias("low"), F.col("most").alias("high"), "lo", "hi")
    one = met.where("num is not null").join(classes.select("num", F.col("n").alias("least"), F.col("n").alias("most"), "grp"), "num")
    all_of = met.where("num is null").join(own, "hub").withColumn("grp", F.lit(None).cast("long"))
    both = one.select(all_of.columns).unionByName(all_of).join(g, "g").where("grp is null or lo <> grp or hi <> grp")
    both = both.where(F.col("c") >= needed(F.col("least"), F.col("low"), percent, need))
    both = both.where((F.col("high") * 100 >= F.col("least") * percent) & (F.col("most") * 100 >= F.col("low") * percent)).select("num", "hub", "g")
    return both.unionByName(special.where("large and mixed").select(F.lit(None).cast("long").alias("num"), "hub", F.col("hub").alias("g")))


def compared(left: list[tuple], right: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is similar between two blocks of (num, grp, set); what is connected already isn't compared."""
    parent = {g: g for _, g, _ in left + right}

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    out = []
    for begin in range(0, len(right), ONCE):
        some = right[begin : begin + ONCE]
        sizes = np.array([len(s) for _, _, s in some])
        tokens = np.concatenate([s for _, _, s in some])
        owner = np.repeat(np.arange(len(some)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        for num, grp, own in left:
            mine = root(grp)
            if all(root(g) == mine for g in {g for _, g, _ in some}):
                continue
            low, high = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
            reach = high - low
            at = np.repeat(low - np.cumsum(reach) + reach, reach) + np.arange(reach.sum())
            met = np.bincount(owner[at], minlength=len(some))
            for k in np.flatnonzero(100 * met >= percent * (len(own) + sizes - met)).tolist():
                other = root(some[k][1])
                if some[k][0] != num and other != mine:
                    parent[other] = mine
                    out.append((num, some[k][0]))
    return out


def open_groups(asking: DataFrame, classes: DataFrame, docs: DataFrame, text: str, key: str, percent: int) -> DataFrame:
    """Links (a, b) between classes and the members of the groups that they must be compared with.

    Both sides are dealt to blocks of about SIDE tokens by hash, and each block of one side meets each of the other,
    so no task holds a whole group.
    """
    named = classes.select("num", "n", "grp")
    asking = written(asking, "asking")
    whole = asking.where("num is null").drop("num").join(classes.select("hub", "num", "n", "grp"), "hub").select("num", "n", "grp", "g")
    opened = written(asking.where("num is not null").join(named, "num").select("num", "n", "grp", "g").unionByName(whole), "opened")
    high = written(opened.groupBy("g").agg(F.ceil(F.sum("n") / SIDE).alias("high")), "high")
    members = written(classes.select("num", "n", "grp", F.col("hub").alias("g")).join(small(high, 24), "g"), "members")
    sizes = written(members.groupBy("g").agg(F.ceil(F.sum("n") / SIDE).alias("wide"), F.first("high").alias("high")), "sizes")
    own = lambda n: F.pmod(F.xxhash64("num"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = opened.join(small(sizes, 32), "g").select("num", "grp", "g", own("high").alias("i"), every("wide").alias("j"), F.lit(0).alias("side"))
    right = members.drop("high").join(small(sizes, 32), "g").select("num", "grp", "g", every("high").alias("i"), own("wide").alias("j"), F.lit(1).alias("side"))
    wanted = written(left.unionByName(right).join(classes.select("num", "h"), "num"), "wanted")
    dealt = with_texts(wanted, docs, text, key, ["num", "grp", "g", "i", "j", "side"]).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sides = None, ([], [])

        def links() -> pa.RecordBatch:
            out = compared(*sides, percent) if sides[0] and sides[1] else []
            return pa.record_batch([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

        for num, grp, g, i, j, side, s in each_set(batches, 6):
            if (g, i, j) != block:
                yield links()
                block, sides = (g, i, j), ([], [])
            sides[side].append((num, grp, np.unique(s)))
        yield links()

    return written(dealt.mapInArrow(compare, "a long, b long"), "opened_links")


def labelled(docs: DataFrame, percent: int, text: str, key: str, need: int = NEED, frequent: int = FREQUENT) -> DataFrame:
    """(key, h, n, cls, first_id, first_h) of each document; first is the one of its component with the smallest key, null keys last."""
    told = written(describe(docs, text, key), "described")
    first = lambda *more: F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", *more)).alias("r")
    classes = told.where("n > 0").withColumnRenamed(key, "id").groupBy("cls").agg(first("least"), F.first("n").alias("n"))
    classes = numbered(classes.select("cls", "n", "r.id", "r.h", "r.least"))
    grouped, links = form_groups(classes, docs, text, key, percent)

    n = F.col("n")
    total = grouped.agg(F.sum(F.least(n, n - F.ceil(n * percent / 100) + need))).first()[0] or 0
    parts = parts_for(total)
    common = find_frequent(grouped, docs, text, key, frequent, percent, need, parts)
    more = open_groups(questions(grouped, docs, text, key, common, percent, need, parts), grouped, docs, text, key, percent)
    found = components(links.unionByName(more) if links is not None else more, "components").select(F.col("node").alias("num"), F.col("component").alias("_c"))

    named = classes.select("cls", "num", "id", "h").join(found, "num", "left").withColumn("_c", F.coalesce("_c", "num"))
    label = named.select("cls", "_c").join(named.groupBy("_c").agg(first()), "_c").select("cls", F.col("r.id").alias("first_id"), F.col("r.h").alias("first_h"))
    return told.drop("least").join(label, "cls", "left")


def join(docs: DataFrame, percent: int = PERCENT, text: str = "text", key: str = "doc_id", need: int = NEED, frequent: int = FREQUENT) -> DataFrame:
    """One row for each document: n_shingles and component_id, the smallest key reachable by links."""
    told = labelled(docs, percent, text, key, need, frequent)
    return told.select(key, F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col(key)).otherwise(F.col("first_id")).alias("component_id"))


def keep_first(docs: DataFrame, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents, whole rows, less all but one of each component: that of its smallest key (null keys last), and one of rows that share key and text."""
    told = written(labelled(docs, percent, text, key).select("h", F.coalesce(F.col("h") == F.col("first_h"), F.lit(True)).alias("first")), "told")
    name = "_h" * (1 + max(map(len, docs.columns)))  # longer than any column's
    named = docs.withColumn(name, hash_of(key, text))
    dropped = written(told.where("not first").select(F.col("h").alias(name)).distinct(), "dropped")
    stay = named.join(small(dropped, 24), name, "left_anti")
    twice = written(told.where("first").groupBy("h").count().where(F.col("count") > 1).select(F.col("h").alias(name)), "twice")
    if not twice.isEmpty():
        few = small(twice, 24)
        stay = stay.join(few, name, "left_anti").unionByName(stay.join(few, name, "left_semi").dropDuplicates([name]))
    return stay.select(docs.columns)
