"""Operator 6: removal of repeated line runs by a suffix array over line ids.

1. Lines that occur once leave.  The others get ranks, and runs of 1, 2, 4 ... lines get ranks by prefix doubling: the rank
   of a run is the number of positions whose run sorts before it, so ranks of a round refine those of the round before
   and a position that stands alone has its place in the suffix array.  It retires then, and so do positions whose
   text ends, or goes on with a line that occurs once.
2. The suffix array is dealt by ranges into chunks.  The longest common prefix of neighbours follows from the ranks of
   all rounds, the longest runs first.
3. Within a chunk, and over what the chunks on both sides leave to it, the intervals of common prefixes give for each
   position the longest run that also starts at an earlier position.  Such runs with enough characters are deleted.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.lineage import discard
from engramlake.llm.common import NO_ID, materialize, slices, table

MIN_CHARS = 40
#: Positions in a chunk of the suffix array.
CHUNK_ROWS = 50_000
#: Rows in a range of a running sum.
RANGE_ROWS = 1_000_000

_KEY = ["d", "h"]
_PLACE = "d long, h long, pos long"
_ENDS, _ALONE = -1, -2

Place = tuple[int, int, int]
Stairs = list[tuple[int, Place]]  # (length, earliest place), both rising


def reaches(lengths: np.ndarray, least: int) -> np.ndarray:
    """For each line the number of lines, itself included, that reach ``least`` characters; zero where the text ends before."""
    n = len(lengths)
    total = np.concatenate([[0], np.cumsum(lengths)])
    end = np.searchsorted(total, total[:-1] + least, "left")
    return np.where(end <= n, end - np.arange(n), 0)


def _shown(text: str) -> list[tuple[int, str]]:
    """Places and texts of the lines that aren't blank."""
    return [(i, line) for i, line in enumerate(text.split("\n")) if line.strip(" \t\r\v\f")]


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """A row for each line that isn't blank: document key, place among these lines, lines from there on, number of the
    row, 128-bit digest, reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            cols: list[list] = [[] for _ in range(6)]
            digest = []
            for doc, own, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                row += 1
                shown = _shown(text or "")
                n = len(shown)
                if not n:
                    continue
                reach = reaches(np.array([len(line) for _, line in shown]), least)
                for c, x in zip(cols, (np.full(n, doc, np.int64), np.full(n, own, np.int64), np.arange(n), np.arange(n, 0, -1), np.full(n, row, np.int64), reach)):
                    c.append(x)
                digest += [xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")) for _, line in shown]
            if not digest:
                continue
            halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            found = [*(np.concatenate(c) for c in cols), halves[:, 0], halves[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in found], names=["d", "h", "pos", "rest", "row", "reach", "a", "b"])

    return docs.mapInArrow(run, f"{_PLACE}, rest long, row long, reach long, a long, b long")


def distinct_lines(keyed: DataFrame, least: int) -> DataFrame:
    """The lines of each document (d, h) once, whatever the number of rows that repeat it."""
    lines = materialize(_lines(keyed, least), "lines")
    heads = lines.where("pos = 0").groupBy(*_KEY).agg(F.min("row").alias("kept"), F.count(F.lit(1)).alias("n"))
    repeated = materialize(heads.where("n > 1").drop("n"), "repeated")
    if not repeated.limit(1).count():
        return lines
    return materialize(lines.join(repeated, _KEY, "left").where("kept IS NULL OR row = kept").drop("kept"), "lines")


def running_sums(df: DataFrame, order: list[str], amounts: list[str], rows: int) -> DataFrame:
    """``df`` with the sums of ``amounts`` over the rows that stand before in ``order``, named before_ and the amount.  Rows,
    ``rows`` at most, are dealt by ranges; the driver sees one row of totals for each range."""
    spark = df.sparkSession
    into = [f"before_{c}" for c in amounts]
    names = [c for c in df.columns]
    at = [names.index(c) for c in amounts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), [0] * len(at)
        for batch in batches:
            own = []
            for k, i in enumerate(at):
                x = batch.column(i).to_numpy()
                total = np.cumsum(x) + so_far[k]
                own.append(total - x)
                so_far[k] = int(total[-1]) if len(x) else so_far[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), *map(pa.array, own)], names=[*names, "part", *into])

    parts = -(-rows // RANGE_ROWS) + 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", part int" + "".join(f", {c} long" for c in into)
    stored = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema), "sums")
    totals = sorted(map(tuple, stored.groupBy("part").agg(*(F.sum(c).alias(c) for c in amounts)).collect()))
    starts, so_far = [], [0] * len(amounts)
    for part, *own in totals:
        starts.append((part, *so_far))
        so_far = [x + y for x, y in zip(so_far, own)]
    starts = spark.createDataFrame(starts, "part int" + "".join(f", start_{c} long" for c in amounts))
    return stored.join(F.broadcast(starts), "part").select(*names, *((F.col(i) + F.col(f"start_{c}")).alias(i) for i, c in zip(into, amounts)))


def suffix_array(lines: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """(retired positions, levels).  A retired position has its rank ``sa`` in the suffix array, the last round ``k`` in which
    it took part, and in ``tie`` the length of what it shares with all others of its rank, which end like it.  ``levels[k]``
    has the ranks of the runs of 2^k lines that occur more than once.

    ``ahead_of`` counts the positions still active before a rank's own; within a round it turns a sum over the active
    positions into the place within the rank."""
    counts = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranks = materialize(running_sums(counts, ["a", "b"], ["n"], lines.count() // 2).select("a", "b", F.col("before_n").alias("r")), "ranks")
    active = materialize(lines.join(ranks, ["a", "b"]).select(*_KEY, "pos", "rest", "reach", "r", F.col("r").alias("ahead_of")), "positions")
    retired: DataFrame | None = None
    levels = []
    while n := active.count():
        k, h = len(levels), 1 << len(levels)
        levels.append(active.select(*_KEY, "pos", "r"))
        known = levels[-1] if retired is None else levels[-1].union(retired.select(*_KEY, "pos", F.col("sa").alias("r")))
        ahead = known.select(*_KEY, (F.col("pos") - h).alias("pos"), F.col("r").alias("ahead"))
        # a line that occurs once sorts by a number of its own
        alone = F.lit(_ALONE) - F.xxhash64(*_KEY, F.col("pos") + h).bitwiseAND(F.lit((1 << 62) - 1))
        after = F.coalesce("ahead", F.when(F.col("rest") <= h, F.lit(_ENDS).cast("long")).otherwise(alone))
        pairs = materialize(active.join(ahead, [*_KEY, "pos"], "left").select(*_KEY, "pos", "rest", "reach", "r", "ahead_of", after.alias("r2")), "pairs")
        counts = pairs.groupBy("r", "ahead_of", "r2").agg(F.count(F.lit(1)).alias("n"))
        done = (F.col("n") == 1) | (F.col("r2") < 0)
        counts = running_sums(counts.withColumn("still", F.when(done, 0).otherwise(F.col("n")).cast("long")), ["r", "r2"], ["n", "still"], n)
        ranks = materialize(counts.select("r", "r2", "n", (F.col("r") + F.col("before_n") - F.col("ahead_of")).alias("sa"), "before_still"), "ranks")
        placed = materialize(pairs.drop("ahead_of").join(ranks, ["r", "r2"]), "placed")
        discard(pairs)
        discard(ranks)
        tie = F.when(F.col("r2") == _ENDS, F.col("rest")).otherwise(h).cast("long")
        out = placed.where(done).select(*_KEY, "pos", "reach", "sa", tie.alias("tie"), F.lit(k).alias("k"))
        retired = out if retired is None else retired.union(out)
        active = placed.where(~done).select(*_KEY, "pos", "rest", "reach", F.col("sa").alias("r"), F.col("before_still").alias("ahead_of"))
    return retired, levels


_ROW = ["chunk", "at", "d", "h", "pos", "reach", "sa", "tie", "k"]
_BEFORE = ["pd", "ph", "ppos", "psa", "pk"]


def neighbours(retired: DataFrame) -> DataFrame:
    """The suffix array in chunks: each position with the one before it.  Chunks are ranges of (rank, place), so that they
    are of like size whatever the ranks; the driver sees the last row of each."""
    n = retired.count()
    order = ["sa", "d", "h", "pos"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, at, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy().astype(np.int64) for c in batch.columns]
            before = [np.concatenate([[c[0] if last is None else last[i]], c[:-1]]) for i, c in enumerate(cols)]
            last = [c[-1] for c in cols]
            place = np.arange(at, at + len(cols[0]))
            at += len(cols[0])
            d, h, pos, _, sa, _, k = before
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(place), chunk), place, *cols, d, h, pos, sa, k)], names=[*_ROW, *_BEFORE])

    schema = ", ".join(f"{c} long" for c in [*_ROW, *_BEFORE])
    parts = max(1, -(-n // CHUNK_ROWS))
    ordered = retired.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*_KEY, "pos", "reach", "sa", "tie", "k")
    stored = materialize(ordered.mapInArrow(number, schema), "array")
    ends = stored.groupBy("chunk").agg(F.max(F.struct("at", "d", "h", "pos", "sa", "k")).alias("end")).collect()
    ends = sorted((r["chunk"], *r["end"]) for r in ends)
    starts = [(b[0], *a[2:]) for a, b in zip(ends, ends[1:])]
    if ends:
        starts.append((ends[0][0], None, None, None, -1, -1))  # the first position of all follows none
    heads = stored.sparkSession.createDataFrame(starts, "chunk long, qd long, qh long, qpos long, qsa long, qk long")
    joined = stored.join(F.broadcast(heads), "chunk", "left")
    own = [F.when(F.col("at") == 0, F.col("q" + c[1:])).otherwise(F.col(c)).alias(c) for c in _BEFORE]
    return joined.select(*_ROW, *own)


def common_prefixes(array: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The array with ``l``, the number of lines that a position and the one before it have in common."""
    slim = array.select("chunk", "at", "d", "h", "pos", "reach", "pd", "ph", "ppos", F.least("k", "pk").alias("k"),
                        F.when(F.col("sa") == F.col("psa"), F.col("tie")).alias("tied"))
    slim = materialize(slim.withColumn("l", F.coalesce("tied", F.lit(0)).cast("long")), "neighbours")
    shown = ["chunk", "at", "d", "h", "pos", "reach", "pd", "ph", "ppos", "l"]
    todo = stored = None
    for k in range(len(levels) - 1, -1, -1):
        own = slim.where((F.col("k") == k) & F.col("tied").isNull()).select(*shown)
        todo = own if todo is None else todo.union(own)
        level = levels[k]
        x = level.select(*_KEY, F.col("pos").alias("x"), F.col("r").alias("rx"))
        y = level.select(F.col("d").alias("pd"), F.col("h").alias("ph"), F.col("pos").alias("y"), F.col("r").alias("ry"))
        met = todo.withColumn("x", F.col("pos") + F.col("l")).withColumn("y", F.col("ppos") + F.col("l"))
        met = met.join(x, [*_KEY, "x"], "left").join(y, ["pd", "ph", "y"], "left")
        longer = F.coalesce((F.col("rx") == F.col("ry")).cast("long"), F.lit(0)) * (1 << k)
        todo = materialize(met.withColumn("l", F.col("l") + longer).select(*shown), "prefixes")
        if stored is not None:
            discard(stored)
        stored = todo
    settled = slim.where("tied IS NOT NULL OR k < 0").select(*shown)
    out = settled if todo is None else todo.union(settled)
    return materialize(out.select("chunk", "at", "d", "h", "pos", "reach", "l"), "prefixes")


def stairs(pairs: list[tuple[int, Place]]) -> Stairs:
    """Of (length, place) those that no other beats: as long or longer, and earlier."""
    out: Stairs = []
    for length, place in sorted(pairs, key=lambda x: (-x[0], x[1])):
        if length > 0 and (not out or place < out[-1][1]):
            out.append((length, place))
    return out[::-1]


def reach_of(known: Stairs, place: Place) -> int:
    """The largest length with an earlier place."""
    at = bisect_left(known, place, key=lambda x: x[1])
    return known[at - 1][0] if at else 0


def previous_runs(places: list[Place], common: list[int], left: Stairs, right: Stairs) -> list[int]:
    """For each position of a chunk the longest run that also starts at an earlier position.

    ``common[i]`` is what position i shares with the one before it, ``left`` and ``right`` what the chunks before and after
    hold.  Positions leave a linked list from the latest on, so those left are earlier, and an entry that leaves hands
    the smaller of two prefixes to the next."""
    n = len(places)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    shared = [*common, 1 << 62]
    out = [0] * n
    for i in sorted(range(n), key=places.__getitem__, reverse=True):
        p, q = before[i], after[i]
        a = shared[i] if p >= 0 else min(shared[i], reach_of(left, places[i]))
        b = shared[q] if q < n else min(shared[q], reach_of(right, places[i]))
        out[i] = max(a, b)
        if p >= 0:
            after[p] = q
        if q < n:
            before[q] = p
        shared[q] = min(shared[q], shared[i])
    return out


def _chunk(t: pa.Table) -> tuple[list[Place], list[int], np.ndarray]:
    t = t.sort_by("at")
    return list(zip(*(t.column(c).to_pylist() for c in ("d", "h", "pos")))), t.column("l").to_pylist(), t.column("reach").to_numpy()


def repeated_runs(keyed: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(d, h, start, n): from each position of a document (d, h) the longest run of lines that also starts at an earlier
    position, if it has ``least`` characters; positions are ordered by d, h and line."""
    retired, levels = suffix_array(distinct_lines(keyed, least))
    none = keyed.sparkSession.createDataFrame([], "d long, h long, start long, n long")
    if retired is None:
        return none
    array = common_prefixes(neighbours(retired), levels)

    def outer(t: pa.Table) -> pa.Table:
        """What a chunk holds for the chunks after (side 0) and before it (side 1), and its least prefix (side 2)."""
        places, common, _ = _chunk(t)
        chunk = t.column("chunk")[0].as_py()
        found: list[tuple[int, int, Place]] = [(2, min(common), (0, 0, 0))]
        low, pairs = 1 << 62, []
        for place, c in zip(reversed(places), reversed(common)):
            pairs.append((low, place))
            low = min(low, c)
            if not low:
                break
        found += [(0, *x) for x in stairs(pairs)]
        low, pairs = 1 << 62, []
        for place, c in zip(places, common):
            low = min(low, c)
            if not low:
                break
            pairs.append((low, place))
        found += [(1, *x) for x in stairs(pairs)]
        return pa.table({"chunk": pa.array([chunk] * len(found), pa.int64()), "side": pa.array([x[0] for x in found], pa.int32()), "l": pa.array([x[1] for x in found], pa.int64()),
                         **{c: pa.array([x[2][i] for x in found], pa.int64()) for i, c in enumerate(("d", "h", "pos"))}})

    held: dict[int, list] = {}
    for r in array.groupBy("chunk").applyInArrow(outer, f"chunk long, side int, l long, {_PLACE}").collect():
        held.setdefault(r["chunk"], [[], [], 0])
        if r["side"] == 2:
            held[r["chunk"]][2] = r["l"]
        else:
            held[r["chunk"]][r["side"]].append((r["l"], (r["d"], r["h"], r["pos"])))
    order = sorted(held)
    left: dict[int, Stairs] = {}
    right: dict[int, Stairs] = {}
    for side, chunks, into in ((0, order, left), (1, order[::-1], right)):
        now: Stairs = []
        for c in chunks:
            into[c] = now
            now = stairs(held[c][side] + [(min(length, held[c][2]), place) for length, place in now])
    shared = keyed.sparkSession.sparkContext.broadcast((left, right))

    def inner(t: pa.Table) -> pa.Table:
        places, common, reach = _chunk(t)
        chunk = t.column("chunk")[0].as_py()
        run = np.array(previous_runs(places, common, shared.value[0][chunk], shared.value[1][chunk]), np.int64)
        at = np.flatnonzero((reach > 0) & (run >= reach))
        own = np.array(places, np.int64).reshape(-1, 3)[at]
        return pa.table({"d": own[:, 0], "h": own[:, 1], "start": own[:, 2], "n": run[at]})

    return array.groupBy("chunk").applyInArrow(inner, "d long, h long, start long, n long")


def cut_lines(docs: DataFrame, least: int = MIN_CHARS, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, named c0, c1 ... by their places, with the text left, n_lines and n_removed as in
    :func:`drop_repeated_lines`."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    doc, at = names[docs.columns.index(doc_col)], docs.columns.index(text_col)
    d, h = F.coalesce(F.col(doc).cast("long"), F.lit(int(NO_ID))).alias("d"), F.xxhash64(names[at]).alias("h")
    marks = repeated_runs(plain.select(d, h, F.col(names[at]).alias("text")), least).groupBy("d", "h").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    marks = materialize(marks, "marks")
    joined = plain.select(*names, d, h).join(marks, ["d", "h"], "left").select(*names, "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names[at]):
            texts, counts, gone = [], [], []
            for text, runs in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                shown = _shown(text or "")
                change = np.zeros(len(shown) + 1, np.int64)
                for r in runs or ():
                    change[r["start"]] += 1
                    change[r["start"] + r["n"]] -= 1
                drop = np.flatnonzero(np.cumsum(change[:-1]) > 0)
                counts.append(len(shown))
                gone.append(len(drop))
                if len(drop):
                    away = {shown[i][0] for i in drop}
                    text = "" if len(drop) == len(shown) else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in away)
                texts.append(text)
            cols = [batch.column(i) if i != at else pa.array(texts, pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "n_lines", "n_removed"])

    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(names, docs.schema)) + ", n_lines long, n_removed long"
    return joined.mapInArrow(cut, schema)


def drop_repeated_lines(docs: DataFrame, least: int = MIN_CHARS, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text left in ``text_col``, and n_lines and n_removed (lines that aren't blank).

    A line goes if it lies in a run of lines with at least ``least`` characters that also occurs at an earlier
    position; positions are ordered by id, then by a hash of the text, then by line.  Single long lines are runs.
    Blank lines belong to no run; a text whose other lines are all gone is empty.  Null texts stay null; a null id
    comes last; rows that repeat an id and its text are one document and share its decisions.  Columns named
    n_lines or n_removed are replaced.  No rows give no rows.
    """
    found = cut_lines(docs, least, doc_col, text_col)
    rest = [i for i, c in enumerate(docs.columns) if c not in ("n_lines", "n_removed")]
    return found.select(*(f"c{i}" for i in rest), "n_lines", "n_removed").toDF(*(docs.columns[i] for i in rest), "n_lines", "n_removed")


def lined_documents(docs: DataFrame, least: int = MIN_CHARS, doc_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` of which a line is left, or that had none, columns unchanged but for the text and, where there is
    such a column, its length."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    left = cut_lines(docs, least, doc_col, text_col).where("n_removed < n_lines OR n_lines = 0")
    text = names[docs.columns.index(text_col)]
    sized = [F.length(text).cast("long").alias(c) if own == length_col else F.col(c) for c, own in zip(names, docs.columns)]
    return left.select(*sized).toDF(*docs.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def brute_force(docs: list[tuple], least: int = MIN_CHARS) -> list[tuple]:
    """(doc_id, n_lines, n_removed, text) for documents with distinct ids, in the order of ids."""
    first: dict[tuple, tuple] = {}
    all_runs = []
    ordered = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0))
    for k, (_, text) in enumerate(ordered):
        shown = [line for _, line in _shown(text or "")]
        runs = set()
        for i in range(len(shown)):
            for j in range(i, len(shown)):
                if sum(map(len, shown[i : j + 1])) >= least:
                    runs.add((i, j + 1))
                    break
            for j in range(i, -1, -1):
                if sum(map(len, shown[j : i + 1])) >= least:
                    runs.add((j, i + 1))
                    break
        for i, j in sorted(runs):
            first.setdefault(tuple(shown[i:j]), (k, i))
        all_runs.append(runs)
    out = []
    for k, (doc, text) in enumerate(ordered):
        shown = _shown(text or "")
        drop = {x for i, j in all_runs[k] if first[tuple(line for _, line in shown[i:j])] < (k, i) for x in range(i, j)}
        away = {shown[i][0] for i in drop}
        left = text if not drop else "" if len(drop) == len(shown) else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in away)
        out.append((doc, len(shown), len(drop), left))
    return out


def oracle() -> str:
    blank = r"trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) = ''"
    return rf"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE text IS NOT NULL),
shown AS (SELECT doc_id, line, x, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS p, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY line) AS c FROM raw WHERE NOT ({blank})),
per AS (SELECT doc_id, list(x ORDER BY p) AS xs FROM shown GROUP BY doc_id),
span AS (
  SELECT a.doc_id, a.p AS i, min(b.p) AS j FROM shown a JOIN shown b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.c - a.c + length(a.x) >= {MIN_CHARS} GROUP BY a.doc_id, a.p
  UNION
  SELECT b.doc_id, max(a.p) AS i, b.p AS j FROM shown a JOIN shown b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.c - a.c + length(a.x) >= {MIN_CHARS} GROUP BY b.doc_id, b.p
),
run AS (SELECT span.doc_id, i, j, list_slice(xs, i, j) AS k FROM span JOIN per USING (doc_id)),
own AS (SELECT k, min({{'d': doc_id, 'i': i}}) AS o FROM run GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, j + 1)) AS p FROM run JOIN own USING (k) WHERE o < {{'d': doc_id, 'i': i}})),
cnt AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
tot AS (SELECT doc_id, count(*) AS n FROM shown GROUP BY doc_id),
gl AS (SELECT doc_id, line FROM gone JOIN shown USING (doc_id, p)),
txt AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY line) AS t FROM raw ANTI JOIN gl USING (doc_id, line) GROUP BY doc_id)
SELECT d.doc_id, coalesce(tot.n, 0)::BIGINT AS n_lines, coalesce(cnt.n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN cnt.n = tot.n THEN '' ELSE coalesce(t, '') END) AS text_sha256
FROM documents d LEFT JOIN tot USING (doc_id) LEFT JOIN cnt USING (doc_id) LEFT JOIN txt USING (doc_id)"""
