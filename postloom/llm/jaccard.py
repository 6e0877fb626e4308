"""N-gram Jaccard join by a token-group matrix, exact for every pair.

1. Texts become sets of shingle codes. Equal sets form a class; one set per class goes on.
2. A set can only link if three quarters of its tokens occur in other sets. This is bounded first on the
   tokens of the lowest codes (cheap, no second reading of text), then on all tokens of the sets left.
3. The sets left are sorted by their lowest codes and cut into groups of similar sets, as many as the sets and their
   tokens need, whatever the partitions. The matrix holds, by token, the sets with that token in their head (the rarest three quarters) and their groups. It tells how many head
   tokens of a set the union of a group has; a set opens a group only if these reach the bound for any link.
4. An opened group bounds the overlap of the query with the union of its members' tokens and compares
   members only if the bound reaches the threshold. Links leave as a spanning forest and as counts.
5. Components of classes come from stars over the links.

Frequent tokens are counted once per batch and token before the shuffle; queries of a group are split by
their tokens, so no task holds more than a bounded number of tokens of a group. Codes have 64 bits: two
different shingles with equal codes are the only source of error (chance about pairs of shingles / 2^64).

Cases: null and empty texts have no shingles and are their own component; texts of fewer than five words are
one shingle; repeated rows and repeated ids are rows of their own; a null id links like any other and shows
the smallest id that is not null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.llm.common import few, join_one, keyed, materialise, on_key, query, small_batches, table
from postloom.llm.components import components
from postloom.llm.shingles import WordCodes, shingle_set

#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Part of the code space whose tokens bound a set before its other tokens are looked at.
LOW_PART = 0.35
#: Tokens of one range of the code space, of the sets that go to the matrix together, members and tokens of one group, tokens of a
#: group's queries in a task.
RANGE_TOKENS, MATRIX_TOKENS = 500_000, 400_000
#: Meetings of a token of a set with a group that are counted together.
MEETINGS = 250_000
GROUP_SETS, GROUP_TOKENS = 2048, 1_000_000
QUERY_TOKENS = 2_000_000
#: Rows that leave a task together.
ROWS = 500
#: Tokens in more sets than this are ordered last; at most FREQUENT_MOST tokens are (the rate rises with the data).
FREQUENT, FREQUENT_MOST = 256, 500_000

_SETS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()),
                   ("cls", pa.int64()), ("low", pa.binary())])
_FULL = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])
_CHUNK = pa.schema([("part", pa.int64()), ("tokens", pa.binary()), ("sets", pa.binary()), ("at", pa.binary()), ("times", pa.binary())])
_COUNT = pa.schema([("cls", pa.int64()), ("shared", pa.int64())])
#: Bytes of a low token: its lowest 16 bits are left out, which can only make a set look more linkable.
LOW_BYTES = 6


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def least_shared(n: int | np.ndarray) -> int | np.ndarray:
    """Tokens that a set of ``n`` shares at least with any set it links with."""
    return -(-PERCENT * n // 100)


def least_hits(n: int) -> int:
    """Head tokens that a set of ``n`` has in common at least with the head of any set it links with.

    The head is the first ``n - least_shared(n) + h`` tokens in the common order, with ``h`` half of ``n``. Of the tokens two linked
    sets share, at most ``least_shared - h`` lie behind the head that ends first, so it holds ``h`` of them, and so does the other.
    The ``h`` that counts is that of the smaller set, of at least ``least_shared(n)`` tokens.
    """
    return max(1, int(least_shared(n)) // 2)


def _u64(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _low(data: bytes) -> np.ndarray:
    whole = np.zeros((len(data) // LOW_BYTES, 8), np.uint8)
    whole[:, 8 - LOW_BYTES:] = np.frombuffer(data, np.uint8).reshape(-1, LOW_BYTES)
    return whole.reshape(-1).view(np.uint64)


def _read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, top = WordCodes(), np.uint64(LOW_PART * 2**64)
    for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
        rows = []
        for uid, doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            tokens = shingle_set(text.as_py(), codes)
            cls = xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63
            low = tokens[:np.searchsorted(tokens, top)].view(np.uint8).reshape(-1, 8)[:, 8 - LOW_BYTES:]
            rows.append((uid, doc_id, key, len(tokens), cls, low.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SETS, strict=True)]
                                         if rows else [pa.array([], f.type) for f in _SETS], schema=_SETS)


def document_sets(docs: DataFrame) -> DataFrame:
    """uid, doc_id, text_hash, n, class of equal sets and the tokens of the lowest codes, written once."""
    rows = small_batches(docs).select(F.monotonically_increasing_id(), F.col("doc_id").cast("long"), F.xxhash64("text"), "text")
    return materialise(rows.mapInArrow(_read_sets, _ddl(_SETS)), "jaccard-sets")


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = WordCodes()
    for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
        tokens = [shingle_set(text.as_py(), codes) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in tokens], pa.int64()),
             pa.array([x.tobytes() for x in tokens], pa.binary())], schema=_FULL)


def _place(tokens: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each token and, below it, 32 other bits of its code.

    Tokens of a range that agree in these count as one; as ranges grow with the tokens, few do at any size.
    """
    part = (tokens >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    return part << np.uint64(32) | tokens >> np.uint64(16) & np.uint64(0xFFFFFFFF)


def _spread(ranges: int, counters: int, read):
    """Rows (cls, tokens) to rows by range of tokens; tokens repeated in a batch go once, with their times.

    Sets that hold a token repeated in their batch are credited at once, in rows of part -1 - counter.
    """

    def emit(cls: list[int], tokens: list[bytes]) -> Iterator[pa.RecordBatch]:
        arrays = [read(x) for x in tokens]
        flat = _place(np.concatenate(arrays), ranges)
        owner = np.repeat(np.arange(len(cls), dtype=np.uint16), [len(x) for x in arrays])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        times = np.diff(np.r_[first, len(flat)])
        names = np.array(cls, np.int64)
        rows = []
        starts = np.searchsorted(flat[first], np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32))
        seen = np.minimum(times, 255).astype(np.uint8)
        for p in np.flatnonzero(np.diff(starts)):
            at = slice(starts[p], starts[p + 1])
            held, place = np.unique(owner[first[at]], return_inverse=True)
            rows.append((int(p), flat[first[at]].astype(np.uint32).tobytes(), names[held].tobytes(),
                         place.astype(np.uint16).tobytes(), seen[at].tobytes()))
        yield from _chunks(rows + _credits(names[owner[np.repeat(times > 1, times)]], counters), _CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, tokens, size = [], [], 0
        for batch in batches:
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    cls.append(c)
                    tokens.append(t)
                    size += len(t)
                if size > 4_000_000 or len(cls) == 2**16:
                    yield from emit(cls, tokens)
                    cls, tokens, size = [], [], 0
        if size:
            yield from emit(cls, tokens)

    return run


def _credits(owner: np.ndarray, counters: int) -> list[tuple]:
    """How many tokens each set is credited with, in one row per counter."""
    sets, times = np.unique(owner, return_counts=True)
    counter = sets % counters
    order = np.argsort(counter, kind="stable")
    sets, times, counter = sets[order], times[order], counter[order]
    starts = np.searchsorted(counter, np.arange(counters + 1))
    return [(-1 - int(c), b"", sets[starts[c]:starts[c + 1]].tobytes(), b"", times[starts[c]:starts[c + 1]].tobytes())
            for c in np.flatnonzero(np.diff(starts))]


def _chunks(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, f.type) for x, f in zip(zip(*rows[at:at + 64], strict=True), schema, strict=True)], schema=schema)


def _gather(counters: int, frequent: int):
    """Rows of one range: credits of the sets whose token another batch has too, and frequent tokens (part 0)."""

    def run(group: pa.Table) -> pa.Table:
        rows = list(zip(*(c.to_pylist() for c in group.columns), strict=True))
        if rows[0][0] < 0:
            return group
        flat = np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows])
        owner = np.concatenate([np.frombuffer(r[2], np.int64)[np.frombuffer(r[3], np.uint16)] for r in rows])
        times = np.concatenate([np.frombuffer(r[4], np.uint8) for r in rows]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        flat, owner, times = flat[order], owner[order], times[order]
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        batches = np.diff(np.r_[first, len(flat)])
        newly = np.repeat(batches > 1, batches) & (times == 1)
        often = flat[first[np.add.reduceat(times, first) > frequent]] | np.uint64(rows[0][0]) << np.uint64(32)
        out = _credits(owner[newly], counters) + ([(0, often.tobytes(), b"", b"", b"")] if len(often) else [])
        return pa.Table.from_batches(list(_chunks(out, _CHUNK)), schema=_CHUNK)

    return run


def _sum_credits(group: pa.Table) -> pa.Table:
    sets = np.concatenate([np.frombuffer(x, np.int64) for x in group.column(2).to_pylist()])
    times = np.concatenate([np.frombuffer(x, np.int64) for x in group.column(4).to_pylist()])
    cls, at = np.unique(sets, return_inverse=True)
    return pa.table([pa.array(cls), pa.array(np.bincount(at, times, len(cls)).astype(np.int64))], schema=_COUNT)


def shared_counts(sets: DataFrame, total: int, read, purpose: str) -> tuple[DataFrame, np.ndarray, int]:
    """(cls, shared): tokens of each set that another set has too; the places of frequent tokens; the ranges.

    ``sets`` has rows (cls, tokens), read by ``read``; ``total`` is how many tokens they hold at most. As many
    places are frequent as the rate allows, at most FREQUENT_MOST.
    """
    ranges = max(8, -(-total // RANGE_TOKENS))
    counters = max(4, ranges // 4)
    gather = _gather(counters, max(FREQUENT, total // FREQUENT_MOST))
    spread = sets.mapInArrow(_spread(ranges, counters, read), _ddl(_CHUNK))
    gathered = materialise(spread.groupBy("part").applyInArrow(gather, _ddl(_CHUNK)), purpose)
    counted = gathered.filter("part < 0").groupBy("part").applyInArrow(_sum_credits, _ddl(_COUNT))
    found = [_u64(r["tokens"]) for r in gathered.filter("part = 0").select("tokens").collect()]
    return counted, np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64), ranges


def _linkable(sets: DataFrame, counted: DataFrame, known: str) -> DataFrame:
    """Sets of which enough tokens may be shared; ``known`` is how many tokens were counted."""
    return sets.join(counted, "cls", "left").filter(
        F.expr(f"100 * (n - {known} + coalesce(shared, 0)) >= {PERCENT} * n")).drop("shared")


_ORDERED = "piece long, cls long, n long, tokens binary, sets_before long, tokens_before long"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets in order with the number of sets and of tokens before each in its piece."""
    members, size = 0, 0
    for batch in batches:
        upto = size + np.cumsum(batch.column(2).to_numpy())
        before = [np.arange(members, members + batch.num_rows), np.r_[size, upto[:-1]][:batch.num_rows]]
        members, size = members + batch.num_rows, int(upto[-1]) if len(upto) else size
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in before)],
                                         names=[*batch.schema.names, "sets_before", "tokens_before"])


def token_groups(core: DataFrame) -> DataFrame:
    """(grp, cls, n, tokens): sets ordered by their lowest codes (similar sets mostly share these), then cut.

    Ranges of the order are sorted by many tasks and written once; a cut counts the sets and tokens of all ranges before
    it, so a group goes on over the end of a range, and there is one per GROUP_SETS sets and one per GROUP_TOKENS tokens.
    """
    order = [F.substring("tokens", 1, 8), F.substring("tokens", 9, 8), F.col("cls")]
    parts = max(1, -(-core.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()["s"] // (2 * GROUP_TOKENS)))
    ranged = core.select("cls", "n", "tokens").repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    placed = materialise(ranged.select(F.spark_partition_id().cast("long").alias("piece"), "cls", "n", "tokens").mapInArrow(
        _running, _ORDERED), "jaccard-groups")
    pieces = placed.groupBy("piece").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("size"))
    upto = Window.orderBy("piece")
    starts = materialise(pieces.select("piece", (F.sum("sets").over(upto) - F.col("sets")).alias("sets_at"),
                                       (F.sum("size").over(upto) - F.col("size")).alias("tokens_at")), "jaccard-pieces")
    cuts = f"(sets_at + sets_before) div {GROUP_SETS} + (tokens_at + tokens_before) div {GROUP_TOKENS}"  # rises at each cut
    return placed.join(few(starts), "piece").select(F.expr(cuts).alias("grp"), "cls", "n", "tokens")


def _matrix_rows(ranges: int, often: np.ndarray, places: int):
    """Head tokens of each set, rarest first, by range of tokens, with the set, its group and its least hits."""

    def emit(flat: list, sets: list, groups: list, hits: list) -> Iterator[pa.RecordBatch]:
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(x) for x in flat])
        place = _place(np.concatenate(flat), ranges)
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        starts = np.searchsorted(place, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32))
        names, homes, least = (np.array(x, np.int64) for x in (sets, groups, hits))
        rows = []
        for p in np.flatnonzero(np.diff(starts)):
            held, at = np.unique(owner[starts[p]:starts[p + 1]], return_inverse=True)
            rows.append((int(p), place[starts[p]:starts[p + 1]].astype(np.uint32).tobytes(), names[held].tobytes(),
                         at.astype(np.uint16).tobytes(), np.concatenate([homes[held], least[held]]).tobytes()))
        yield from _chunks(rows, _CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [])
        size = 0
        for batch in batches:
            for grp, cls, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = _u64(data)
                if len(often):
                    late = np.isin(_place(tokens, places), often)
                    tokens = np.r_[tokens[~late], tokens[late]]
                for x, y in zip(held, (tokens[:n - least_shared(n) + max(1, n // 2)], cls, grp, least_hits(n)), strict=True):
                    x.append(y)
                size += n
                if size > MATRIX_TOKENS or len(held[1]) == 2**16:
                    yield from emit(*held)
                    held, size = ([], [], [], []), 0
        if size:
            yield from emit(*held)

    return run


_PAIR = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("from_one", pa.binary()), ("from_two", pa.binary())])
_OPEN = pa.schema([("cls", pa.int64()), ("grp", pa.int64())])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many tokens of this range each set has in common with each group, by pair of groups.

    A side of a pair is rows of (set, hits, least hits); a group with itself has one side. In a family of near copies the counts are
    as many as its sets times its groups, so whole groups are counted with some groups at a time and sent on: each group has one
    row with each group that it meets, or half of one, however many sets they hold.
    """
    cols = [c.to_pylist() for c in pa.Table.from_batches(batches).columns]
    tokens = np.concatenate([np.frombuffer(x, np.uint32) for x in cols[1]])
    raw = np.concatenate([np.frombuffer(x, np.int64) for x in cols[2]])
    info = np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in cols[4]], axis=1)
    names, first, place = np.unique(raw, return_index=True, return_inverse=True)
    shift = np.cumsum([0, *(len(x) // 8 for x in cols[2])])
    sets = place.astype(np.int32)[np.concatenate([np.frombuffer(x, np.uint16) + np.int32(k) for x, k in zip(cols[3], shift[:-1], strict=True)])]
    groups, home = np.unique(info[0][first], return_inverse=True)
    least, wide = info[1][first], len(groups)
    del cols, raw, info, place
    order = np.argsort(tokens, kind="stable")
    tokens, sets = tokens[order], sets[order]
    cut = np.r_[True, tokens[1:] != tokens[:-1]]
    often = np.diff(np.r_[np.flatnonzero(cut), len(tokens)])
    token = np.cumsum(cut, dtype=np.int32) - np.int32(1)
    kept = often[token] > 1
    token, sets = token[kept], sets[kept]
    del order, tokens, cut, kept
    held, members = np.unique(token.astype(np.int64) * wide + home[sets], return_counts=True)
    holder, owner = held // wide, held % wide
    start = np.searchsorted(holder, np.arange(len(often) + 1))
    many = (start[1:] - start[:-1])[token]
    order = np.lexsort((sets, home[sets]))
    token, sets, many = token[order], sets[order], many[order]
    fresh = np.flatnonzero(np.r_[True, home[sets[1:]] != home[sets[:-1]]]) if len(sets) else np.empty(0, int)
    block = (np.cumsum(many) - many)[fresh] // MEETINGS
    cuts = fresh[np.r_[True, block[1:] != block[:-1]]] if len(sets) else fresh
    for s, e in zip(cuts, [*cuts[1:], len(sets)], strict=True) if len(sets) else ():
        asked, back = np.unique(token[s:e].astype(np.int64), return_inverse=True)
        parts = min(wide, -(-int(many[s:e].sum()) // MEETINGS))
        edges = [np.searchsorted(held, asked * wide + k * wide // parts) for k in range(parts + 1)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            rep = (high - low)[back]
            at = np.repeat(low[back] - np.r_[0, np.cumsum(rep)[:-1]], rep) + np.arange(rep.sum())
            x = np.repeat(sets[s:e].astype(np.int64), rep)
            met = (owner[at] != home[x]) | (members[at] > 1)  # a set alone in its group does not meet itself
            yield from _sides(*np.unique(x[met] * wide + owner[at][met], return_counts=True), wide, home, groups, names, least)


def _sides(keys: np.ndarray, hits: np.ndarray, wide: int, home: np.ndarray, groups: np.ndarray, names: np.ndarray,
           least: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows by pair of groups of hits by set and group (a key is set * wide + group)."""
    x, other = keys // wide, keys % wide
    one, two = np.minimum(home[x], other), np.maximum(home[x], other)
    order = np.lexsort((two, one))
    x, hits, one, two = x[order], hits[order], one[order], two[order]
    cuts = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.empty(0, int)
    rows = []
    for s, e in zip(cuts, [*cuts[1:], len(one)], strict=True) if len(one) else ():
        side = np.stack([names[x[s:e]], hits[s:e], least[x[s:e]]], axis=1)
        left = home[x[s:e]] == one[s]
        rows.append((int(groups[one[s]]), int(groups[two[s]]), side[left].tobytes(), side[~left].tobytes()))
    yield from _chunks(rows, _PAIR)


def _openings(group: pa.Table) -> pa.Table:
    """Sets that open a group: those whose hits over all ranges reach their least, of the side with fewer such.

    Of two linked sets each reaches its least with the other's group, so either side meets all links.
    """
    one, two = group.column(0)[0].as_py(), group.column(1)[0].as_py()
    sides = []
    for c in (2, 3):
        rows = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 3) for x in group.column(c).to_pylist()])
        names, first, back = np.unique(rows[:, 0], return_index=True, return_inverse=True)
        sides.append(names[np.bincount(back, rows[:, 1], len(names)) >= rows[first, 2]])
    sets, opened = (sides[0], two) if one == two or len(sides[0]) <= len(sides[1]) else (sides[1], one)
    return pa.table([pa.array(sets), pa.array(np.full(len(sets), opened))], schema=_OPEN)


_LINK = pa.schema([("kind", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


class _Forest(dict):
    """Disjoint sets; ``join`` tells whether it joined two."""

    def __missing__(self, x: int) -> int:
        self[x] = x
        return x

    def root(self, x: int) -> int:
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self[x] = y
        return x != y


def _open_group(members: pa.Table, queries: pa.Table) -> pa.Table:
    """Links between a group's members and the sets that open it: spanning links (kind 0), counts (kind 1).

    The overlap with the union of the members' tokens bounds that with each; only sets whose bound reaches
    their threshold are compared. Counts weigh a linked set by its copies.
    """
    m = members.to_pydict()
    sizes, copies = np.array(m["n"], np.int64), np.array(m["copies"], np.int64)
    names, home = np.array(m["cls"], np.int64), m["grp"][0] if m["grp"] else None
    if home is None or not queries.num_rows:
        return pa.table([pa.array([], f.type) for f in _LINK], schema=_LINK)
    arrays = [_u64(x) for x in m["tokens"]]
    flat = np.concatenate(arrays)
    owner = np.repeat(np.arange(len(arrays)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    union, starts = np.unique(flat, return_index=True)
    ends = np.r_[starts[1:], len(flat)]
    place = {c: i for i, c in enumerate(m["cls"])}
    forest, edges = _Forest(), []
    linked, counts = np.zeros(len(names), np.int64), {}
    q = queries.to_pydict()
    for cls, n, own, held, data in zip(q["cls"], q["n"], q["home"], q["copies"], q["tokens"], strict=True):
        tokens = _u64(data) if data is not None else arrays[place[cls]]
        at = np.searchsorted(union, tokens)
        at = at[at < len(union)]
        hit = at[union[at] == tokens[:len(at)]]
        if len(hit) < least_shared(n):
            continue
        which = np.concatenate([owner[s:e] for s, e in zip(starts[hit], ends[hit], strict=True)])
        overlap = np.bincount(which, minlength=len(names))
        good = 100 * overlap >= PERCENT * (n + sizes - overlap)
        if own == home:
            good[:place[cls] + 1] = False
        good = np.flatnonzero(good)
        if not len(good):
            continue
        linked[good] += held
        counts[cls] = counts.get(cls, 0) + int(copies[good].sum())
        edges += [(0, cls, y) for y in names[good].tolist() if forest.join(cls, y)]
    edges += [(1, c, v) for c, v in counts.items()]
    edges += [(1, c, v) for c, v in zip(names.tolist(), linked.tolist(), strict=True) if v]
    return pa.table([pa.array(x, pa.int64()) for x in (zip(*edges, strict=True) if edges else ([], [], []))], schema=_LINK)


def group_links(groups: DataFrame, openings: DataFrame, copies: DataFrame) -> DataFrame:
    """Open every group for its queries; queries of a group are split so that a task holds few tokens.

    A query of its own group brings no tokens along: the members' are there.
    """
    loads = few(materialise(openings.join(groups.select("cls", "n"), "cls").groupBy("grp").agg(
        F.ceil(F.sum("n") / QUERY_TOKENS).alias("parts")), "jaccard-loads"))
    held = groups.join(few(copies), "cls")
    asking = few(materialise(openings.join(loads, "grp").select(
        "cls", F.col("grp").alias("opened"), F.pmod(F.xxhash64("cls"), F.col("parts")).alias("part")), "jaccard-asking"))
    split = held.join(asking, "cls").select(
        "cls", "n", F.col("grp").alias("home"), F.col("opened").alias("grp"), "part", "copies",
        F.when(F.col("grp") != F.col("opened"), F.col("tokens")).alias("tokens"))
    members = held.join(loads, "grp").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    own, asked = ([F.col(c).alias(c) for c in ("grp", "part", "cls", "n", "copies", "tokens", *more)]  # fresh columns for both sides
                  for more in ((), ("home",)))
    return members.select(*own).groupBy("grp", "part").cogroup(split.select(*asked).groupBy("grp", "part")).applyInArrow(
        _open_group, _ddl(_LINK))


def memberships(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, component (its name; null without shingles), component_id and n_links of every document."""
    sets = document_sets(docs)
    filled = sets.filter("n > 0")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    classes = materialise(filled.groupBy("cls").agg(
        F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.min_by("uid", first).alias("uid")), "jaccard-classes")
    carriers = filled.join(few(classes.select("uid")), "uid")
    total = sets.agg(F.coalesce(F.sum(F.octet_length("low")), F.lit(0)).alias("b")).first()["b"] // LOW_BYTES
    counted, _, _ = shared_counts(carriers.select("cls", "low"), total, _low, "jaccard-low-shared")
    sized = carriers.select("cls", "doc_id", "text_hash", "n", F.expr(f"octet_length(low) div {LOW_BYTES}").alias("k"))
    able = few(materialise(_linkable(sized, counted, "k").drop("k"), "jaccard-able"))
    rows = docs.select(F.col("doc_id").cast("long").alias("key_id"), F.xxhash64("text").alias("key_text"), "text")
    found = rows.join(able, on_key(rows, able)).select("cls", "text").mapInArrow(_full_sets, _ddl(_FULL))
    repeats = sets.join(able.select("doc_id", "text_hash"), ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").count()
    if not repeats.filter("count > 1").isEmpty() or not able.filter("doc_id IS NULL").isEmpty():
        found = found.dropDuplicates(["cls"])
    full = materialise(found, "jaccard-full")
    total = full.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    counted, often, places = shared_counts(full.select("cls", "tokens"), total, _u64, "jaccard-full-shared")
    groups = token_groups(_linkable(full, counted, "n"))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    ranges = max(8, -(-total // RANGE_TOKENS))
    openings = groups.mapInArrow(_matrix_rows(ranges, often, places), _ddl(_CHUNK)).groupBy("part").applyInArrow(
        _meetings, _ddl(_PAIR)).groupBy("one", "two").applyInArrow(_openings, _ddl(_OPEN))
    opened = materialise(openings, "jaccard-openings")
    links = materialise(group_links(groups, opened, classes.select("cls", "copies")), "jaccard-links")
    reached = components(links.filter("kind = 0").select("a", "b"))
    counts = links.filter("kind = 1").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("links"))
    named = materialise(classes.join(reached.withColumnRenamed("node", "cls"), "cls", "left").join(counts, "cls", "left").select(
        "cls", "least_id", "copies", F.coalesce("component", "cls").alias("component"), "links"), "jaccard-named")
    per = materialise(named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("classes")),
                      "jaccard-components")
    size = named.agg(F.count(F.lit(1)).alias("classes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    final = materialise(join_one(named, per, "component", "classes", size["classes"], per.count()).select(
        "cls", "component", "component_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "jaccard-final")
    known = join_one(sets.select("doc_id", "text_hash", "n", "cls").filter("n > 0"), final, "cls", "copies", size["rows"], size["classes"])
    none = [F.lit(None).cast("long").alias(c) for c in ("component", "component_id", "n_links")]
    return known.drop("cls", "copies").unionByName(sets.filter("n = 0").select("doc_id", "text_hash", "n", *none))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (documents linked with it) of every document."""
    return memberships(docs).select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``: of each component that with the smallest id; all rows without shingles."""
    found = materialise(memberships(docs).filter("n > 0").select("doc_id", "text_hash", "component"), "jaccard-members")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = materialise(found.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("members")), "jaccard-first")
    per_key = join_one(found.groupBy("doc_id", "text_hash", "component").agg(F.count(F.lit(1)).alias("rows")), first,
                       "component", "members", found.count(), first.count())
    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash"))
    other = materialise(per_key.select("doc_id", "text_hash", stays.alias("stays"), "rows").filter("NOT stays OR rows > 1"),
                        "jaccard-dropped")
    rows, gone, again = keyed(docs), few(other), few(other.filter("stays"))
    single = rows.join(gone, on_key(rows, gone), "left_anti")
    once = rows.join(again, on_key(rows, again), "left_semi").dropDuplicates(["key_id", "key_text"])
    return single.unionByName(once).select("row.*")


_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * o >= 75 * (s.n + t.n - o)),
reach AS (SELECT x AS a, x AS b FROM links UNION SELECT a, y FROM reach JOIN links ON b = x),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, coalesce(least.component_id, d.doc_id) AS component_id,
       coalesce(degree.n_links, 0) AS n_links
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id LEFT JOIN degree ON degree.x = d.doc_id"""


@query("op9_jaccard_join", _SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under shingle Jaccard of at least 0.75."""
    return jaccard_join(table(spark, sf_dir, "documents"))
