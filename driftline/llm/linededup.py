"""Near-duplicate lines by a segment-partition edit join.

Two lines at edit distance ``EDITS`` or less agree in at least one of
``EDITS + 1`` segments of either of them (Li et al. 2011).  Each distinct line is
indexed by its segments; for every admissible length of a partner it probes
those of its substrings that could be the partner's segment, given how far an
alignment can shift.  Lines that meet in a probe are verified by banded
bit-parallel edit distance (Hyyro 2003), which runs over many pairs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.components import connected_components
from driftline.llm.storage import staged
from driftline.llm.textbatch import runs, utf8

#: Lines within so many single-character edits are near-duplicates.
EDITS = 2
#: Lines of all lengths take part.
LEAST_CHARS = 0
#: Of a pair, the shorter line has at least so many characters an edit; with fewer than this only equal lines match.
CHARS_PER_EDIT = 12
#: Lines with a partner that are broadcast to the text scan at most; beyond it both sides are shuffled.
BROADCAST_LINES = 1_000_000
#: Lines of a key that are compared in one piece, on either side.
BLOCK = 256


# --- verification ---


def _banded(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray, edits: int) -> np.ndarray:
    """Edit distances of rows of code point matrices, ``edits + 1`` where they are larger.

    ``a_len <= b_len <= a_len + edits`` and ``a_len > edits``.  Column ``j`` of the
    matrix keeps rows ``j - edits .. j + edits`` as bits of one word per pair: bit
    ``i`` is row ``j + i - edits``.  The lowest band row's value is followed down
    the diagonal until it meets the last row, then along that row.
    """
    n = len(a)
    width = 2 * edits + 1
    one = np.uint64(1)
    mask = np.uint64((1 << width) - 1)
    # Row r of the pattern is padded[r + edits - 1]; code 0 matches nothing.
    padded = np.zeros((n, a.shape[1] + 3 * edits + int((b_len - a_len).max(initial=0)) + 2), dtype=a.dtype)
    padded[:, edits : edits + a.shape[1]] = a
    rising = np.full(n, ((1 << width) - 1) ^ ((1 << edits) - 1), dtype=np.uint64)  # rows 1.. grow by one each
    falling = np.zeros(n, dtype=np.uint64)
    score = np.full(n, edits, dtype=np.int64)
    for j in range(1, int(b_len.max(initial=0)) + 1):
        char = b[:, j - 1]
        match = np.zeros(n, dtype=np.uint64)
        for i in range(width):
            match |= (padded[:, j + i - 1] == char).astype(np.uint64) << np.uint64(i)
        flat = ((((match & rising) + rising) ^ rising) | match | falling) & mask
        right_up = falling | (~(flat | rising) & mask)
        right_down = flat & rising
        live = j <= b_len
        diagonal = live & (j + edits <= a_len)
        score += diagonal & ((flat >> np.uint64(2 * edits)) & one == 0)
        along = live & ~diagonal
        if along.any():
            at = np.clip(a_len - j + edits, 0, 2 * edits).astype(np.uint64)
            step = ((right_up >> at) & one).astype(np.int64) - ((right_down >> at) & one).astype(np.int64)
            score += np.where(along, step, 0)
        down = flat >> one
        rising = (right_down | ~(down | right_up)) & mask
        falling = down & right_up
    return np.minimum(score, edits + 1)


def edit_distances(left: list[str], right: list[str], edits: int = EDITS) -> np.ndarray:
    """Edit distances of string pairs, ``edits + 1`` for any beyond ``edits``."""
    out = np.full(len(left), edits + 1, dtype=np.int64)
    order = []
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        if len(x) > len(y):
            x, y = y, x
        x, y = _different_middles(x, y)
        if x == y:
            out[k] = 0
        elif len(x) <= edits:
            # Too short for a band: all of it can be replaced.
            out[k] = _plain(x, y) if len(y) <= 2 * edits else edits + 1
            out[k] = min(out[k], edits + 1)
        elif len(y) - len(x) <= edits:
            order.append((len(y), k, x, y))
    order.sort(key=lambda t: t[:2])
    lo = 0
    while lo < len(order):
        # Groups of similar length with a bounded matrix.
        hi = lo + 1
        while hi < len(order) and hi - lo < 4096 and (hi - lo + 1) * order[hi][0] <= 4_000_000:
            hi += 1
        part = order[lo:hi]
        wide = part[-1][0]
        a, b = (np.zeros((len(part), wide), np.uint32) for _ in range(2))
        for row, (_, _, x, y) in enumerate(part):
            for matrix, text in ((a, x), (b, y)):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) + 1
                matrix[row, : len(codes)] = codes
        a_len, b_len = np.array([len(p[2]) for p in part]), np.array([len(p[3]) for p in part])
        out[[p[1] for p in part]] = _banded(a, a_len, b, b_len, edits)
        lo = hi
    return out


def _different_middles(x: str, y: str) -> tuple[str, str]:
    """Both without the start and the end that they share; their distance stays the same."""
    lo, hi = 0, len(x)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x[lo:mid] == y[lo:mid] else (lo, mid - 1)
    x, y = x[lo:], y[lo:]
    lo, hi = 0, len(x)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x[len(x) - mid : len(x) - lo] == y[len(y) - mid : len(y) - lo] else (lo, mid - 1)
    return x[: len(x) - lo], y[: len(y) - lo]


def _plain(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, cx in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, cy in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (cx != cy))
    return row[-1]


# --- signatures ---


def segments(length: np.ndarray, edits: int = EDITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and size of each of the ``edits + 1`` segments of lines of these lengths; later ones may be one longer."""
    size, longer = length // (edits + 1), length % (edits + 1)
    out = []
    for i in range(edits + 1):
        before = np.maximum(0, i - (edits + 1 - longer))
        out.append((i * size + before, size + (i >= edits + 1 - longer)))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    full = np.full(n, base & (2**64 - 1), dtype=np.uint64)
    full[:1] = 1
    return np.cumprod(full, dtype=np.uint64)


def signatures(codes: np.ndarray, bounds: np.ndarray, edits: int = EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, role (1 probe, 2 index and probe) and key of all signatures of lines ``codes[bounds[i]:bounds[i + 1]]``.

    What a line is indexed by is also what it probes for partners of its own
    length without a shift; it is one signature.
    Shorter lines allow fewer than ``edits``, see ``CHARS_PER_EDIT``.
    """
    with np.errstate(over="ignore"):
        terms = _mixed(codes.astype(np.uint64) + np.uint64(1)) * _powers(_INVERSE, len(codes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    lift = _powers(_BASE, len(codes) + 1)
    found = []
    for n in range(1, edits + 1):
        most = CHARS_PER_EDIT * (n + 1) if n < edits else np.iinfo(np.int64).max
        found.append(_signatures(sums, lift, bounds, n, CHARS_PER_EDIT * n, most))
    lines, roles, keys = (np.concatenate(c) for c in zip(*found, strict=True))
    return lines, roles, keys


def _signatures(
    sums: np.ndarray, lift: np.ndarray, bounds: np.ndarray, edits: int, least: int, most: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures for pairs whose shorter line has ``least`` characters or more, but fewer than ``most``.

    A key hashes partner length, segment number and content.  Content hashes
    are polynomial, taken from running sums, so any substring costs the same.
    """
    with np.errstate(over="ignore"):
        begin, length = bounds[:-1], np.diff(bounds)
        lines, roles, keys = [], [], []

        def add(rows: np.ndarray, role: int, partner: np.ndarray, i: int, start: np.ndarray, size: np.ndarray) -> None:
            at = begin[rows] + start
            content = (sums[at + size] - sums[at]) * lift[at]
            lines.append(rows)
            roles.append(np.full(len(rows), role, np.int8))
            keys.append(_mixed(content + _mixed((partner * (edits + 1) + i).astype(np.uint64))))

        rows = np.flatnonzero((length >= least) & (length < most))
        for i, (start, size) in enumerate(segments(length[rows], edits)):
            add(rows, 2, length[rows], i, start, size)
        # Partners are no longer than the probing line, so each pair meets once.
        for gap in range(edits + 1):
            rows = np.flatnonzero((length - gap >= least) & (length - gap < most))
            mine, partner = length[rows], length[rows] - gap
            for i, (start, size) in enumerate(segments(partner, edits)):
                # Shifts that leave enough edits for what lies left and what lies right of the segment.
                low = max(-i, gap - (edits - i))
                high = min(i, gap + (edits - i))
                for shift in range(low, high + 1):
                    if not gap and not shift:
                        continue
                    place = start + shift
                    fits = (place >= 0) & (place + size <= mine)
                    add(rows[fits], 1, partner[fits], i, place[fits], size[fits])
        return np.concatenate(lines), np.concatenate(roles), np.concatenate(keys)


# --- Spark operator ---


def _line_key(line: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a line's text."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


def lines_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, print, line_no, line)`` of every line; null texts have none."""
    return docs.filter("text IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("print"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")
    )


def _codes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points, bounds of the rows in them) of runs of lines."""
    buf, offsets = utf8(column)
    for lo, hi in runs(offsets, 1 << 20):
        text = buf[offsets[lo] : offsets[hi]]
        heads = (text & 0xC0) != 0x80
        codes = np.frombuffer(text.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        yield lo, codes, np.concatenate([[0], np.cumsum(heads)])[offsets[lo : hi + 1] - offsets[lo]]


def _signature_batches(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    """(key, role, h1, h2) of the lines of a task, each line's text once."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        fresh = []
        for i, pair in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
            if pair not in seen:
                seen.add(pair)
                fresh.append(i)
        if len(seen) > 2_000_000:  # repeats beyond cost rows, not results
            seen.clear()
        kept = batch.take(pa.array(fresh, pa.int64()))
        h1, h2 = h1[fresh], h2[fresh]
        for lo, codes, bounds in _codes(kept.column("line")):
            line, role, key = signatures(codes, bounds, edits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(role), pa.array(h1[lo + line]), pa.array(h2[lo + line])],
                ["key", "role", "h1", "h2"],
            )


def _distinct(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (key, role, h1, h2) of the keys with several, once each and in order, as index (role 0) and probe (1); where keys start."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(part[0])) + 1, [part.shape[1]]])
    size = np.diff(starts)
    part = part[:, np.repeat(size > 1, size)]
    twice = part[:, part[1] == 2]
    twice[1] = 0
    part[1, part[1] == 2] = 1
    part = np.concatenate([twice, part], axis=1)
    part = part[:, np.lexsort(part[::-1])]
    if part.shape[1]:
        part = part[:, np.append(True, (np.diff(part) != 0).any(axis=0))]
    return part, np.concatenate([[0], np.flatnonzero(np.diff(part[0])) + 1, [part.shape[1]]]) if part.shape[1] else np.zeros(1, np.int64)


def _by_key(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`_distinct` of whole keys; rows come in order of the first column, the key."""
    held: list[np.ndarray] = []  # of the key that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in names])
        last = int(np.searchsorted(rows[0], rows[0, -1]))
        if last or (held and held[-1][0, -1] != rows[0, 0]):
            yield _distinct(np.concatenate([*held, rows[:, :last]], axis=1))
            held = []
        held.append(rows[:, last:])
    if held:
        yield _distinct(np.concatenate(held, axis=1))


def _cell_batches(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """(key, p, q, role, h1, h2): the lines that meet in a key, dealt to cells of ``block`` index and ``block`` probe rows at most."""
    for rows, starts in _by_key(batches, ["key", "role", "h1", "h2"]):
        size = np.diff(starts)
        if not len(size):
            continue
        indexed = np.add.reduceat((rows[1] == 0).astype(np.int64), starts[:-1])
        probes = size - indexed
        # A line always meets itself.
        alone = (size == 2) & (rows[2:, starts[:-1]] == rows[2:, starts[1:] - 1]).all(axis=0)
        busy = (indexed > 0) & (probes > 0) & ~alone
        large = busy & (np.maximum(indexed, probes) > block)
        parts = [np.insert(rows[:, np.repeat(busy & ~large, size)], 1, [[0], [0]], axis=0)]
        for g in np.flatnonzero(large).tolist():
            one = rows[:, starts[g] : starts[g + 1]]
            n, m = int(indexed[g]), int(probes[g])
            across, down = -(-n // block), -(-m // block)
            # Every index block meets every probe block: a row goes to the cells of one line or column.
            mine = np.concatenate([np.arange(n), np.arange(m)]) // block
            times = np.where(one[1] == 0, down, across)
            row = np.repeat(np.arange(n + m), times)
            other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            role = one[1, row]
            cell = np.where(role == 0, [mine[row], other], [other, mine[row]])
            parts.append(np.concatenate([one[:1, row], cell, one[1:, row]]))
        for part in parts:
            for lo in range(0, part.shape[1], 100_000):
                piece = part[:, lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in piece], ["key", "p", "q", "role", "h1", "h2"])


_NONE = np.iinfo(np.int64).max


def _padded(lines: np.ndarray, keys: np.ndarray, n: int, filler: int) -> np.ndarray:
    """A row of keys a line."""
    order = np.argsort(lines, kind="stable")
    count = np.bincount(lines, minlength=n)
    out = np.full((n, int(count.max(initial=0))), filler, np.int64)
    nth = np.arange(len(lines)) - np.repeat(np.cumsum(count) - count, count)
    out[lines[order], nth] = keys[order]
    return out


def _lowest_shared(index: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """The lowest key that each row of both has."""
    low = np.full(len(index), _NONE)
    for i in range(index.shape[1]):
        met = np.zeros(len(index), dtype=bool)
        for j in range(probe.shape[1]):
            met |= index[:, i] == probe[:, j]
        np.minimum(low, index[:, i], out=low, where=met)
    return low


def _meetings(role: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index row and probe row of all meetings in cells, in bounded pieces; a cell's index rows come first."""
    indexed = np.add.reduceat((role == 0).astype(np.int64), starts[:-1])
    probes = np.diff(starts) - indexed
    p = np.flatnonzero(role == 1)
    first, many = np.repeat(starts[:-1], probes), np.repeat(indexed, probes)
    ends = np.cumsum(many)
    lo = 0
    while lo < len(p):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 200_000)))
        m = many[lo:hi]
        yield np.repeat(first[lo:hi], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m), np.repeat(p[lo:hi], m)
        lo = hi


def _linked(cells: pa.Table, edits: int) -> pa.RecordBatch:
    """(h1, h2, links, r1, r2) of lines with links in whole cells: their number, and a line that the links lead to.

    A pair may meet in many keys, either way round if the lengths are equal;
    it is verified and counted in the lowest of them only.
    """
    columns = {c: cells.column(c).to_numpy() for c in ("key", "p", "q", "role", "h1", "h2")}
    names, at, who = np.unique(
        np.stack([columns["h1"], columns["h2"]]), axis=1, return_index=True, return_inverse=True
    )
    who, n = who.ravel(), names.shape[1]
    texts = cells.column("line").combine_chunks().take(pa.array(at))
    lines, roles, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int8)], [np.zeros(0, np.uint64)]
    for lo, codes, bounds in _codes(texts):
        line, role, key = signatures(codes, bounds, edits)
        lines.append(lo + line)
        roles.append(role)
        keys.append(key)
    line, role, key = np.concatenate(lines), np.concatenate(roles), np.concatenate(keys).view(np.int64)
    index, probe = (_padded(line[role >= k], key[role >= k], n, filler) for k, filler in ((2, 0), (1, 1)))
    texts = texts.to_pylist()
    size = np.array([len(t) for t in texts], np.int64)
    cell = np.stack([columns[c] for c in ("key", "p", "q")])
    starts = np.concatenate([[0], np.flatnonzero((np.diff(cell) != 0).any(axis=0)) + 1, [len(who)]])
    links, root = np.zeros(n, np.int64), np.arange(n)
    for left, right in _meetings(columns["role"], starts):
        differ = who[left] != who[right]
        here, x, y = columns["key"][left[differ]], who[left[differ]], who[right[differ]]
        there, back = _lowest_shared(index[x], probe[y]), _lowest_shared(index[y], probe[x])
        lowest = (there == here) & ((there < back) | ((there == back) & (x < y)))
        x, y = x[lowest], y[lowest]
        gap = edit_distances([texts[i] for i in x.tolist()], [texts[i] for i in y.tolist()], edits)
        near = gap <= np.minimum(edits, np.minimum(size[x], size[y]) // CHARS_PER_EDIT)
        x, y = x[near], y[near]
        links += np.bincount(x, minlength=n) + np.bincount(y, minlength=n)
        while (root[x] != root[y]).any():
            low = np.minimum(root[x], root[y])
            for side in (root[x], root[y]):
                np.minimum.at(root, side, low)
            root = root[root]
    has = np.flatnonzero(links)
    while (root[root] != root).any():
        root = root[root]
    return pa.RecordBatch.from_arrays(
        [pa.array(c) for c in (*names[:, has], links[has], *names[:, root[has]])], ["h1", "h2", "links", "r1", "r2"]
    )


def _linked_batches(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    """:func:`_linked` of rows in order of their cells."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        cell = np.stack([rows.column(c).to_numpy() for c in ("key", "p", "q")])
        moved = np.flatnonzero((np.diff(cell) != 0).any(axis=0))
        last = int(moved[-1]) + 1 if len(moved) else 0
        if last:
            yield _linked(rows.slice(0, last), edits)
        held = rows.slice(last)  # the last cell may go on in the next batch
    if held is not None and held.num_rows:
        yield _linked(held, edits)


def near_lines(
    lines: DataFrame, edits: int = EDITS, broadcast_lines: int = BROADCAST_LINES, block: int = BLOCK
) -> DataFrame:
    """``(node, links, root)`` of lines within the distance of a different line, each known by its struct of two hashes.

    ``lines`` has columns h1, h2 and line.  A line may come in several rows: links
    add up to its number of near lines, and edges from node to root connect what
    links connect.  All pairs that meet in a key are verified, in cells of
    bounded size, but leave a row a line rather than a row a pair.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = lines.select("h1", "h2", "line").mapInArrow(
        lambda b: _signature_batches(b, edits), "key long, role tinyint, h1 long, h2 long"
    )
    cells = staged(
        keyed.repartition(parts, "key")
        .sortWithinPartitions("key")
        .mapInArrow(lambda b: _cell_batches(b, block), "key long, p long, q long, role long, h1 long, h2 long"),
        "line-cells",
    )
    wanted = staged(cells.select("h1", "h2").distinct(), "line-partners")
    if wanted.count() <= broadcast_lines:
        wanted = F.broadcast(wanted)
    found = lines.select("h1", "h2", "line").join(wanted, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    linked = (
        cells.join(found, ["h1", "h2"])
        .repartition(parts, "key", "p", "q")
        .sortWithinPartitions("key", "p", "q", "role")
        .mapInArrow(lambda b: _linked_batches(b, edits), "h1 long, h2 long, links long, r1 long, r2 long")
    )
    node, root = F.struct("h1", "h2"), F.struct(F.col("r1").alias("h1"), F.col("r2").alias("h2"))
    return linked.select(node.alias("node"), "links", root.alias("root"))


def line_classes(docs: DataFrame, edits: int = EDITS, block: int = BLOCK) -> DataFrame:
    """The near-duplicate class of every line.

    Returns ``doc_id, print, line_no, n_chars, links`` (different texts
    within the distance), ``class_doc, class_line`` (where the class comes first, in
    order of doc_id, then text hash, then line) and ``kept`` (it is that place).
    Equal lines are one text; a class is what links connect.  Null texts have no
    lines, null doc_ids come last, and rows that repeat a doc_id and text count
    as one document.
    """
    lines = lines_of(docs).filter(F.char_length("line") >= LEAST_CHARS)
    lines = lines.select("doc_id", "print", "line_no", F.char_length("line").alias("n_chars"), *_line_key(F.col("line")), "line")
    places = staged(lines.drop("line").distinct(), "lines")
    # Equal lines of any length meet by their hashes below; only longer ones can have other partners.
    longer = lines.filter(F.col("n_chars") >= CHARS_PER_EDIT).select("h1", "h2", "line")
    near = staged(near_lines(longer, edits, block=block), "near-lines")
    links = near.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(near.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = classes.join(links, "node", "left").select("node.h1", "node.h2", "label", "links")
    # First place of each text, then of each class: hot lines shrink to a row before they are joined.
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "print", "line_no")
    firsts = places.groupBy("h1", "h2").agg(F.min(order).alias("place"))
    texts = firsts.join(classes, ["h1", "h2"], "left").withColumn("label", F.coalesce("label", F.struct("h1", "h2")))
    heads = texts.groupBy("label").agg(F.min("place").alias("head"))
    named = texts.join(heads, "label").select("h1", "h2", F.coalesce("links", F.lit(0).cast("long")).alias("links"), "head")
    return places.join(named, ["h1", "h2"]).select(
        "doc_id",
        "print",
        "line_no",
        "n_chars",
        "links",
        F.col("head.doc_id").alias("class_doc"),
        F.col("head.line_no").alias("class_line"),
        (order == F.col("head")).alias("kept"),
    )


def without_repeated_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``docs`` with every line removed that repeats, nearly or exactly, an earlier one.

    All rows stay, with all their columns; only texts shrink, and a column
    n_chars follows them.  Empty lines are lines like any other, so of many
    blank lines the first stays.  Null texts stay null, rows that repeat a
    doc_id and text lose the same lines, null doc_ids come last, and empty
    tables and any other columns are fine.
    """
    # Bounds of the lines between two that go: what stays is copied in slices, however many lines there are.
    gone = (
        line_classes(docs, edits)
        .filter(~F.col("kept"))
        .groupBy("doc_id", "print")
        .agg(F.array_sort(F.collect_set("line_no")).alias("gone"))
    )
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.xxhash64("text").alias("print"))
    met = F.col("row.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.print") == F.col("g.print"))
    rows = rows.alias("d").join(gone.alias("g"), met, "left").select("row", "gone")
    lines = F.when(F.col("gone").isNotNull(), F.split("row.text", "\n", -1)).alias("lines")
    rows = rows.select("row", lines, F.concat(F.array(F.lit(-1)), "gone").alias("before"), "gone")
    rows = rows.select("row", "lines", "before", F.concat("gone", F.array(F.size("lines"))).alias("after"))
    parts = F.transform("before", lambda b, i: F.slice("lines", b + 2, F.get("after", i) - b - 1))
    left = F.when(F.col("lines").isNotNull(), F.array_join(F.flatten(parts), "\n"))
    rows = rows.select("row", left.alias("left"))
    new = {"text": F.coalesce("left", "row.text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.coalesce(F.char_length("left").cast(kind), "row.n_chars")
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
