"""Exact Jaccard join of word shingles through a token-group matrix.

Texts are sets of distinct 5-word shingles; two sets link when
``100 * |intersection| >= 75 * |union|``.  Texts with equal sets form one *class*, known
by 128 bits of its set, so copies never meet each other.  A class's number is the first
half of these bits; the few classes that share a half get other numbers, so numbers are
unique too.

Method
------
1. Order.  Tokens (shingles) are ordered by their number, but frequent ones come
   last: the most frequent tokens, counted over all texts, are demoted.  The list of
   demoted tokens has at most ``MAX_DEMOTED`` entries, whatever the input, and is
   broadcast; any order gives the same links, a better one opens fewer groups.
2. A set of n tokens has a *prefix* of its first ``ceil(0.3 n)`` tokens.  Of two sets
   that link, the larger with n tokens, at most 0.7 n common tokens can lie behind
   a prefix, so at least ``0.75 n - 0.7 n = 0.05 n`` lie in both prefixes.  A class
   whose prefix has fewer tokens that other classes also have links with nothing.
3. Groups.  Classes whose most frequent shared token is the same are similar and form a
   group, cut into parts of about ``GROUP`` members; every part also gets the group's
   smallest class as a member, which ties the parts together.  First every group is
   compared within itself, and the links found are contracted to components.
4. Matrix.  A group is cut into *rows* by these components; a row is the union of its
   members' prefix tokens.  Two sets of m >= n tokens that link have 3/7 (m + n) in common, of
   which at most 0.7 m lie behind the prefix that ends first, so their prefixes share
   3/7 n - 19/70 m.  Two rows qualify for each other when they share that, for the greatest
   size m and the least size n of their members, and 0.05 of the greater of their least
   sizes; when these sizes allow a link at all; and when they are not both of one and
   the same component.
5. Hubs.  Where many rows have a token, they first meet only that token's largest row;
   what qualifies is opened and contracted, and the rows are cut anew.  So a large
   group of near copies becomes one component by pairs that grow with its members, not
   with their square.  Then all rows that still qualify are opened, which makes
   the join whole whatever the hubs have found.
6. Of two rows the smaller one's members visit the larger, in parts of ``VISITORS``.
   Inside an opened part the overlap with the union of the members' tokens bounds the
   overlap with each.

Everything that travels is packed: prefix tokens as byte strings for each bucket of
tokens, sets as byte strings.  The number of buckets follows from the tokens counted.
Demoted tokens, which a large part of all texts may have, are dealt to buckets by token
and class, so no token makes a bucket of its own.  Nothing of the size of the texts is
kept: they are read once for each of counts, signatures and prefixes, and once
more for the sets of the classes that have enough shared tokens.

Defined results: a text with no word has an empty set and links with nothing; null
texts are empty; rows that repeat, and rows with equal ids, are separate members of
the class of their text; a null id is greater than every other id; an empty table
gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shingles import SIZE, mix, shingles_of, texts_in
from .staging import give_back, scratch, stage

#: Two sets link from this share of common tokens on, as a fraction.
LEAST, MOST = 75, 100
#: Members of a group at most (and one tie), and visitors that are compared with it at once.
GROUP, VISITORS = 64, 256
#: Members of one component that make a row of the matrix of their own.
ROW = 4
#: Rounds of hubs at most, and the pairs of rows of several components for each entry of the matrix from which one is worth it.
HUBS, CROWDED = 3, 16
#: Tokens that are demoted at most, and the count from which a token may be.
MAX_DEMOTED = 1_000_000
FREQUENT = 8
#: Tokens that are counted together in a task, and prefix tokens of a bucket.
RUN, BUCKET = 1 << 19, 1 << 20
#: Classes that may share the first half of their signatures.
MAX_SHARED = 100_000
#: Ids of texts to be read again that are broadcast at most (8 bytes each); more are joined by shuffling.
BROADCAST_IDS = 2_000_000
_ONE, _TWO = np.uint64(0xA5A5A5A55A5A5A5A), np.uint64(0x3C6EF372FE94F82B)


def prefix_size(n: int) -> int:
    return -(-n * 3 // 10)


def enough(count, n):
    """Whether so many common prefix tokens allow a link of a set of n tokens."""
    return count * 20 >= n


def signature(tokens: np.ndarray) -> bytes:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        a = mix(tokens ^ _ONE).sum(dtype=np.uint64) + np.uint64(len(tokens))
        b = mix(tokens + _TWO).sum(dtype=np.uint64)
    return a.astype(">u8").tobytes() + b.astype(">u8").tobytes()


def _number(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "big", signed=True)


def _exceptions(classes: DataFrame) -> dict[bytes, int]:
    """Numbers of the classes (key, num) that share theirs with others; N classes have some N^2 / 2^65 such pairs."""
    shared = classes.groupBy("num").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("num")
    sigs = sorted(bytes(r[0]) for r in classes.join(shared, "num").select("key").limit(MAX_SHARED + 1).collect())  # bounded
    if len(sigs) > MAX_SHARED:
        raise ValueError(f"more than {MAX_SHARED} classes share their numbers")
    out, free = {}, 0
    while len(out) < len(sigs):
        tried = {s: int.from_bytes(signature(np.frombuffer(s, "<u8") + np.uint64(free))[:8], "big", signed=True) for s in sigs if s not in out}
        used = {r[0] for r in classes.where(F.col("num").isin(*tried.values())).select("num").collect()} | set(out.values())
        for sig, num in tried.items():
            if num not in used:
                out[sig] = num
                used.add(num)
        free += 1
    return out


def _sets(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    for _, data, edges in texts_in(batch.column(column)):
        for tokens in shingles_of(data, edges, SIZE):
            yield np.unique(tokens)


def _packets(tokens: np.ndarray, owners: np.ndarray, buckets: int, salt=np.uint64(0)):
    """Entries dealt to buckets by token and salt: (bucket, tokens, owners) as bytes."""
    bucket = (mix(tokens ^ salt) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, tokens, owners = bucket[order], tokens[order], owners[order]
    cuts = np.nonzero(np.diff(bucket))[0] + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
        if b > a:
            yield int(bucket[a]), tokens[a:b].tobytes(), owners[a:b].tobytes()


def frequent_tokens(docs: DataFrame, text_col: str, buckets: int, most: int = MAX_DEMOTED, least: int = FREQUENT) -> np.ndarray:
    """Tokens that occur in more than ``least`` texts' lower two fifths, the most frequent ones.

    Counted over all texts by lossy counting: a run of about ``RUN`` tokens in one task sends
    those that it has more than once, so a count is too low by at most one for each run.
    """

    def send(batches):
        some: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for s in _sets(batch, 0):
                some.append(s[: -(-len(s) * 2 // 5)])
                held += len(some[-1])
                if held > RUN:
                    yield pack(some)
                    some, held = [], 0
        if some:
            yield pack(some)

    def pack(some):
        tokens, counts = np.unique(np.concatenate(some), return_counts=True)
        tokens, counts = tokens[counts > 1], counts[counts > 1]
        rows = list(_packets(tokens, counts.astype("<u4"), buckets))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
            names=["bucket", "tokens", "counts"],
        )

    def count(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        tokens = np.concatenate([np.frombuffer(t, "<u8") for t, _ in rows])
        counts = np.concatenate([np.frombuffer(c, "<u4") for _, c in rows])
        order = np.argsort(tokens)
        tokens, counts = tokens[order], counts[order]
        first = np.nonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))[0]
        total = np.add.reduceat(counts.astype(np.int64), first)
        kept = total > least
        return pa.RecordBatch.from_arrays([pa.array(tokens[first][kept].view(np.int64)), pa.array(total[kept])], names=["token", "n"])

    sent = docs.select(text_col).mapInArrow(send, "bucket int, tokens binary, counts binary")
    found = _by_group(sent, "bucket", count, "token long, n long").orderBy(F.desc("n"), "token").limit(most).select("token").toArrow()
    return np.sort(found.column("token").to_numpy().astype(np.int64).view(np.uint64))


def _ordered(tokens: np.ndarray, demoted: np.ndarray) -> np.ndarray:
    late = _is_demoted(tokens, demoted)
    return np.concatenate([tokens[~late], tokens[late]]) if late.any() else tokens


def members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Staged (id, n, sig): one row for each text."""

    def run(batches):
        for batch in batches:
            n, sig = [], []
            for s in _sets(batch, 1):
                n.append(len(s))
                sig.append(signature(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["id", "n", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return stage(docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n long, sig binary"), "members")


def _is_demoted(tokens: np.ndarray, demoted: np.ndarray) -> np.ndarray:
    if not len(demoted) or not len(tokens):
        return np.zeros(len(tokens), bool)
    return demoted[np.minimum(np.searchsorted(demoted, tokens), len(demoted) - 1)] == tokens


def shared_tokens(docs: DataFrame, demoted, numbers, text_col: str, buckets: int) -> DataFrame:
    """(token, num): prefix tokens that more than one class has, and all demoted ones."""

    def send(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                own: dict[bytes, np.ndarray] = {}  # copies are sent once
                for s in _sets(batch.slice(at, 2048), 0):
                    if len(s):
                        own.setdefault(signature(s), s)
                if own:
                    yield pack(own)
        give_back()

    def pack(own):
        late, others = demoted.value, numbers.value
        tokens = [_ordered(s, late)[: prefix_size(len(s))] for s in own.values()]
        nums = np.array([others.get(k, _number(k)) for k in own], "<i8")
        local = np.repeat(np.arange(len(tokens), dtype="<u2"), [len(t) for t in tokens])
        tokens = np.concatenate(tokens)
        salt = np.where(_is_demoted(tokens, late), nums.view("<u8")[local], np.uint64(0))
        out = []
        for bucket, t, o in _packets(tokens, local, buckets, salt):
            used, again = np.unique(np.frombuffer(o, "<u2"), return_inverse=True)
            out.append((bucket, t, again.astype("<u2").tobytes(), nums[used].tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32())] + [pa.array([r[k] for r in out], pa.binary()) for k in range(1, 4)],
            names=["bucket", "tokens", "local", "nums"],
        )

    def meet(rows: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        tokens = np.concatenate([np.frombuffer(t, "<u8") for t, _, _ in rows])
        owner = np.concatenate([np.frombuffer(k, "<i8")[np.frombuffer(o, "<u2")] for _, o, k in rows])
        order = np.lexsort((owner, tokens))
        tokens, owner = tokens[order], owner[order]
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])])
        tokens, owner = tokens[new], owner[new]
        same = tokens[1:] == tokens[:-1]
        kept = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | _is_demoted(tokens, demoted.value)
        return pa.RecordBatch.from_arrays([pa.array(tokens[kept].view(np.int64)), pa.array(owner[kept])], names=["token", "num"])

    sent = docs.select(text_col).mapInArrow(send, "bucket int, tokens binary, local binary, nums binary")
    return _by_group(sent, "bucket", meet, "token long, num long")


def _by_group(rows: DataFrame, by: str, run, spec: str) -> DataFrame:
    """``run`` over the rows of each value of the first column, one value at a time in memory."""

    def each(batches):
        name, held = None, []
        for batch in batches:
            own = [c.to_pylist() for c in batch.columns]
            for row in zip(*own):
                if row[0] != name and held:
                    yield run(held)
                    held = []
                name = row[0]
                held.append(row[1:])
            del own
        if held:
            yield run(held)
        give_back()

    order = [by, *[c for c in rows.columns if c == "home"]]
    return rows.repartition(by).sortWithinPartitions(*order).mapInArrow(each, spec)


def _open(groups: DataFrame) -> DataFrame:
    """Links (a, b) inside the bounded groups of (grp, num, tokens, home)."""

    def run(rows) -> pa.RecordBatch:
        found = _links_within(rows) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["a", "b"])

    return _by_group(groups.select("grp", "num", "tokens", "home"), "grp", run, "a long, b long")


def _links_within(rows: list[tuple[int, bytes, bool]]) -> list[tuple[int, int]]:
    """Links inside an opened group (num, tokens, home), of ``home`` members among each other and of visitors with them.

    What is linked already is not linked again: as many links come out as tie the
    group's members, not all pairs.
    """
    hosts = {key: np.frombuffer(tokens, "<u8") for key, tokens, home in rows if home}
    guests = {key: np.frombuffer(tokens, "<u8") for key, tokens, home in rows if not home and key not in hosts}
    key = [*hosts, *guests]
    sets = [*hosts.values(), *guests.values()]
    found, parent = [], list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    if not hosts or len(sets) < 2:
        return found
    sizes = np.array([len(s) for s in sets])
    own_sizes = sizes[: len(hosts)]
    union = np.concatenate(sets[: len(hosts)])  # the row of the matrix, with its members
    owner = np.repeat(np.arange(len(hosts)), own_sizes)
    order = np.argsort(union, kind="stable")
    union, owner = union[order], owner[order]
    for q, tokens in enumerate(sets):
        low = np.searchsorted(union, tokens)
        many = np.searchsorted(union, tokens, side="right") - low
        if np.count_nonzero(many) * MOST < LEAST * sizes[q]:
            continue  # even the union of the group has too little of it
        ends = np.cumsum(many)
        both = np.bincount(owner[np.repeat(low - (ends - many), many) + np.arange(ends[-1])], minlength=len(hosts))
        for i in np.nonzero(MOST * both >= LEAST * (own_sizes + sizes[q] - both))[0].tolist():
            x, y = root(q), root(i)
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((key[q], key[i]))
    return found


def _rows(placed: DataFrame, so_far: DataFrame) -> DataFrame:
    """(num, n, row, size, root): groups cut into rows of the matrix by the components found so far.

    A component with ``ROW`` members of a group or more is a row of its own; the
    others of the group share one.
    """
    named = placed.join(so_far, F.col("num") == F.col("node"), "left").select("num", "n", "grp", F.coalesce("root", "num").alias("root"))
    inside = Window.partitionBy("grp", "root")  # a group has at most some GROUP members
    named = named.withColumn("own", F.when(F.count(F.lit(1)).over(inside) >= ROW, F.col("root")))
    size = F.count(F.lit(1)).over(Window.partitionBy("grp", "own"))
    return named.select("num", "n", F.xxhash64("grp", "own").alias("row"), size.alias("size"), "root")


def _matrix(shared: DataFrame, named: DataFrame) -> DataFrame:
    """Staged (token, row, bounds): one entry however many members of a row have the token; only tokens of several components."""
    entries = shared.join(named.select("num", "row"), "num").select("token", "row").distinct()
    bounds = named.groupBy("row").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("root").alias("r1"), F.max("root").alias("r2"), F.first("size").alias("size")
    )
    entries = stage(entries.join(bounds, "row"), "entries")
    apart = entries.groupBy("token").agg(F.min("r1").alias("low"), F.max("r2").alias("high"), F.count(F.lit(1)).alias("rows"))
    return stage(entries.join(apart.where("low <> high AND rows > 1").select("token", "rows"), "token"), "matrix")


def _calls(entries: DataFrame, others: DataFrame) -> DataFrame:
    """Staged (row_g, row): qualifying pairs among the joined entries; the smaller row visits the larger."""
    guest = entries.toDF(*[c if c == "token" else c + "_g" for c in entries.columns])
    fits = (F.col("most_g") * MOST >= F.col("least") * LEAST) & (F.col("most") * MOST >= F.col("least_g") * LEAST)
    apart = ~((F.col("r1") == F.col("r2")) & (F.col("r1_g") == F.col("r2_g")) & (F.col("r1") == F.col("r1_g")))
    smaller = (F.col("size_g") < F.col("size")) | ((F.col("size_g") == F.col("size")) & (F.col("row_g") < F.col("row")))
    pairs = guest.join(others, "token").where(smaller & fits & apart).groupBy("row_g", "row").agg(
        F.count(F.lit(1)).alias("hits"), F.greatest(F.first("least"), F.first("least_g")).alias("n"),
        F.least(F.first("least"), F.first("least_g")).alias("low"), F.greatest(F.first("most"), F.first("most_g")).alias("high"),
    )
    both = F.col("hits") * 70 >= F.col("low") * 30 - F.col("high") * 19
    return stage(pairs.where(enough(F.col("hits"), F.col("n")) & both).select("row_g", "row"), "qualifying-rows")


def _visit(calls: DataFrame, named: DataFrame, sets: DataFrame) -> DataFrame:
    """Staged links that the members of calling rows have with the rows they call, in parts of about ``VISITORS``."""
    visits = calls.join(named.select(F.col("row").alias("row_g"), "num"), "row_g").select("row", "num").distinct()
    parts = visits.groupBy("row").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("num"), F.col("parts")).cast("int")
    guests = visits.join(parts, "row").select(F.xxhash64("row", part).alias("grp"), "num", F.lit(False).alias("home"))
    hosts = named.select("row", "num").join(parts, "row").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hosts = hosts.select(F.xxhash64("row", "part").alias("grp"), "num", F.lit(True).alias("home"))
    return stage(_open(guests.union(hosts).join(sets, "num")), "outer-links")


def _active(shared: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged (num, n, low_id, first) of classes with enough shared tokens, and staged (token, num) of these tokens.

    A token that only one such class has is none of theirs, which may leave a class with too few.
    """
    hits = shared.groupBy("num").agg(F.count(F.lit(1)).alias("hits")).join(classes.select("num", "n", "low_id"), "num")
    some = stage(hits.where(enough(F.col("hits"), F.col("n"))).drop("hits"), "some-shared")
    tokens = shared.join(some.select("num"), "num", "left_semi")
    several = tokens.groupBy("token").agg(F.min("num").alias("low"), F.max("num").alias("high"), F.count(F.lit(1)).alias("held")).where("low <> high")
    tokens = stage(tokens.join(several.select("token", "held"), "token"), "active-tokens")
    again = tokens.groupBy("num").agg(F.count(F.lit(1)).alias("hits"), F.max_by("token", F.struct("held", "token")).alias("first"))
    active = again.join(some, "num").where(enough(F.col("hits"), F.col("n")))
    return stage(active.select("num", "n", "low_id", "first"), "active"), tokens.drop("held")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): one row for each input row."""
    with scratch(docs.sparkSession, "members", "classes", "owner"):
        return _join(docs, id_col, text_col)


def _join(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("__doc_id"), F.col(text_col).alias("__doc_text"))
    id_col, text_col = docs.columns
    member = members(docs, id_col, text_col)
    lowest = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("low")
    classes = member.where("n > 0").groupBy(F.col("sig").alias("key")).agg(lowest, F.first("n").alias("n"))
    half = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long").alias("num")
    classes = stage(classes.select("key", half, "n", F.col("low.id").alias("low_id")), "classes")
    exceptions = _exceptions(classes)
    if exceptions:
        other = spark.createDataFrame([(bytearray(k), v) for k, v in exceptions.items()], "key binary, other long")
        classes = classes.join(F.broadcast(other), "key", "left").withColumn("num", F.coalesce("other", "num")).drop("other")
    tokens = classes.agg(F.sum("n")).head()[0] or 0
    buckets = 32 + int(prefix_size(tokens) // BUCKET)
    demoted = spark.sparkContext.broadcast(frequent_tokens(docs, text_col, buckets))
    numbers = spark.sparkContext.broadcast(exceptions)
    active, shared = _active(stage(shared_tokens(docs, demoted, numbers, text_col, buckets), "shared-tokens"), classes)

    # groups: classes of one most frequent shared token, in parts, tied by the smallest class
    crowd = active.groupBy("first").agg(F.count(F.lit(1)).alias("crowd"), F.min("num").alias("tie"))
    placed = active.join(crowd, "first").withColumn(
        "part", F.pmod(F.xxhash64("num"), F.ceil(F.col("crowd") / GROUP).cast("long"))
    ).withColumn("grp", F.xxhash64("first", "part"))
    placed = stage(placed.select("num", "n", "grp", "tie", "crowd"), "groups")
    sets = stage(_sets_of(docs, active, numbers, id_col, text_col), "sets")  # read from their texts once more

    ties = placed.where(f"crowd > {GROUP}").select("grp", F.col("tie").alias("num")).distinct()
    homes = placed.where("crowd > 1").select("grp", "num").union(ties).distinct().withColumn("home", F.lit(True))
    links = stage(_open(homes.join(sets, "num")), "inner-links")
    before = float("inf")
    for k in range(HUBS + 1):
        named = stage(_rows(placed, components(links)), "rows")
        entries = _matrix(shared, named)
        whose = F.when(F.col("r1") == F.col("r2"), F.xxhash64("r1")).otherwise(F.col("row"))
        alike = entries.groupBy("token", whose.alias("root")).agg(F.count(F.lit(1)).alias("c"))
        size = alike.groupBy("token").agg(F.sum("c").alias("r"), F.sum(F.expr("c * c")).alias("same")).agg(F.sum("r").alias("held"), F.sum(F.expr("(r * r - same) / 2")).alias("pairs")).head()
        if k == HUBS or not size.held or size.pairs <= CROWDED * size.held or size.pairs > 0.9 * before:
            break  # few rows have a token, or the hubs don't link what is left
        before = size.pairs
        hub = F.max_by(F.struct([c for c in entries.columns if c != "token"]), F.struct("size", "row")).alias("hub")
        calls = _calls(entries, entries.groupBy("token").agg(hub).select("token", "hub.*"))
        links = links.union(_visit(calls, named, sets))
    linked = components(links.union(_visit(_calls(entries, entries), named, sets)))
    every = linked.union(linked.select("root", "root").distinct()).join(active.select("num", "low_id"), F.col("node") == F.col("num"))
    lowest = every.groupBy("root").agg(F.min(F.struct(F.col("low_id").isNull().alias("none"), "low_id"))["low_id"].alias("component"))
    owner = stage(every.join(lowest, "root").select("num", "component"), "owner")
    named = classes.join(owner, "num", "left").select(F.col("key").alias("sig"), F.coalesce("component", "low_id").alias("component"))
    return (
        member.select("id", "n", "sig").join(named, "sig", "left")
        .select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    )


def _sets_of(docs: DataFrame, needed: DataFrame, numbers, id_col: str, text_col: str) -> DataFrame:
    """(num, tokens): the sets of needed classes (num, low_id), from the text of each class's smallest id."""

    def run(batches):
        for batch in batches:
            num, tokens = [], []
            for s in _sets(batch, 0):
                sig = signature(s)
                num.append(numbers.value.get(sig, _number(sig)))
                tokens.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(num, pa.int64()), pa.array(tokens, pa.binary())], names=["num", "tokens"])

    ids = stage(needed.select(F.col("low_id").alias("__id")).distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.join(ids, docs[id_col].eqNullSafe(F.col("__id")), "left_semi").select(text_col)
    read = texts.mapInArrow(run, "num long, tokens binary")
    return read.join(needed.select("num"), "num", "left_semi").dropDuplicates(["num"])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join(docs).withColumnRenamed("id", "doc_id")
