"""Exact Jaccard join of documents on word shingles by metric regions.

Documents are points of the Jaccard metric on sets of shingles, d = 1 - |x & y| /
|x | y|; two documents link when d <= 1 - ``share`` / 100.

First level. Unrelated texts are all at distance 1 of each other, so documents
make no useful pivots here; the pivots are the sets of one shingle. Under a fixed
order of the shingles a document lies in the regions of its first shingles, as
many as the window of the threshold needs: linked documents share ``o >=
share * max(|x|, |y|) / 100`` shingles, so the first ``|x| - ceil(share * |x| /
100) + 1`` of each have one in common. That is the tightest window replication;
the triangle inequality alone would put every document into every region. The
order puts frequent shingles last, so passages that many documents share make no
region unless a document has little else. The list of frequent shingles is
bounded and changes only the order, never the result. Two documents need to be
compared in the region of their first common shingle only, and only if what
follows it in both is enough for a link (``positions_allow``).

Inner levels. A small region takes every document as a pivot and so ends at
once. A larger one chooses a few documents as pivots and measures the distance
of its documents to them. Documents that link to a pivot are one component. A
region is done when its documents are one component; else it goes on with
pivots from outside its largest component, comparing only documents of other
components whose sizes and distances to the region's first pivot are within the
threshold of the triangle inequality. After ``LEVELS`` levels it takes all those
documents as pivots, which ends it exactly. So the links that are found connect
just what all links connect. Pivots are the documents whose region comes first
in their order: those have the fewest shingles of their own and lie in the middle
of a group of near copies.

Before two texts are compared, the difference of their sketches (shingles
counted by leading bits of the hash) must allow a link: it never exceeds the
number of shingles that only one of them has. Texts meet in one task per pivot
and chunk of its partners, sorted, one text at a time.

Exact copies share a digest of the whole set and are tied to the smallest id;
a task passes on one of them. Links, regions and components stay distributed.

``near_duplicates`` needs the components only. ``counted_links`` and ``link_pairs``
go on inside them: a link joins two sets of one component, so each pair of a
component's different sets, of sizes that allow a link, meets once in one task,
in blocks of sets whose intersections are counted as a product of matrices.

Defined results: a NULL or empty text, or one without words, has no shingle and
links with nothing; a NULL id has its count and component NULL and links with
nothing; rows that share an id are one node; other columns are not looked at; an
empty table gives no row. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import arrow_map, forget, kept, steps, text_bytes
from harrow.llm.components import components
from harrow.llm.words import NOT_SPACE, mix, words

STEP_BYTES = 4 << 20
# Shingles counted together when frequent ones are looked for, how often one must be
# seen to be frequent, and how many are listed: they set the order of shingles only.
COUNTED = 2 << 20
FREQUENT = 16
LISTED = 1 << 16
# Regions up to this size compare all their documents at once.
SMALL = 32
# Pivots of a larger region at each level, and levels before it is finished in one.
PIVOTS = 8
LEVELS = 3
# Partners of one pivot that are compared in one task.
PARTNERS = 256
# Region names are so many bits of a shingle's hash; a clash only adds candidates.
REGION_BITS = 48

# All links of a component: different sets of a chunk and their shingles, chunks of a
# block, and shingles that are looked at together.
CHUNK = 32
CHUNK_SHINGLES = 1 << 16
CHUNKS = 32
COLUMNS = 4096

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in ascending order (uint64)."""
    found = words(*text_bytes(column), NOT_SPACE)
    h, of = found.hashes, found.of_text
    whole = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width if len(whole) else 0):
        whole = whole * _STEP + h[k: k + len(whole)]
    whole = mix(whole + np.uint64(width))
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(whole[a: b - width + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            value = np.uint64(0)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    value = value * _STEP + x
                out.append(mix(np.array([value + np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def sketch(own: np.ndarray) -> bytes:
    """How many shingles begin with which bits; about eight for each count."""
    bits = max(4, int(len(own) // 8).bit_length())
    counts = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def sketch_difference(a: bytes, b: bytes) -> int:
    """At most the number of shingles in one set and not in the other."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    n = min(len(x), len(y))
    return int(np.abs(x.reshape(n, -1).sum(axis=1) - y.reshape(n, -1).sum(axis=1)).sum())


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def signatures(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, d1, d2, sketch) of each document, and rows (shingle, times) of shingles seen together."""

    def frequent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.sort(np.concatenate(held))
        new = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        times = np.diff(np.append(new, len(every)))
        more = times > 1
        n = int(more.sum())
        if n:
            empty = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(every[new[more]].view(np.int64)), pa.array(times[more])], names)

    names = ["doc_id", "n", "d1", "d2", "sketch", "shingle", "times"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for step in steps(batches, "text", STEP_BYTES):
            own = shingle_sets(step.column("text"), width)
            digests = [_digest(x) for x in own]
            pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [step.column("doc_id").combine_chunks(), pa.array([len(x) for x in own], pa.int32()), pa.array(pairs[:, 0].copy()),
                 pa.array(pairs[:, 1].copy()), pa.array([sketch(x) for x in own], pa.binary()), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.int64())], names)
            for x, d in zip(own, digests, strict=True):
                if len(x) and d not in seen:
                    seen.add(d)
                    held.append(x)
                    size += len(x)
            if size >= COUNTED:
                yield from frequent(held)
                held, size, seen = [], 0, set()
        if held:
            yield from frequent(held)

    return arrow_map(rows, sign, "doc_id long, n int, d1 long, d2 long, sketch binary, shingle long, times long")


def prefix(own: np.ndarray, hot: np.ndarray, share: int) -> np.ndarray:
    """The first shingles of a set, frequent ones last: as many as a link must meet."""
    n = len(own) - -(-share * len(own) // 100) + 1
    rare = own[~hot]
    return rare[:n] if len(rare) >= n else np.concatenate((rare, own[hot][: n - len(rare)]))


def regions(rows: DataFrame, frequent: np.ndarray, width: int, share: int) -> DataFrame:
    """(r1, r2, size, doc_id, n, pos, pivot, pivot_n, pivot_pos): regions of two documents or more.

    ``pos`` is the place of the region's shingle among the document's. Regions
    with the same documents are one, r1 and r2 hash its documents, and the place
    is that of the first of their shingles.
    """
    shared = rows.sparkSession.sparkContext.broadcast(np.sort(frequent))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = set(), shared.value
        for step in steps(batches, "text", STEP_BYTES):
            sets = shingle_sets(step.column("text"), width)
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            if len(known):
                at = np.searchsorted(known, every)
                hot = known[np.minimum(at, len(known) - 1)] == every
            else:
                hot = np.zeros(len(every), bool)
            ends = np.cumsum([len(x) for x in sets])
            ids, firsts, sizes = [], [], []
            for doc, own, end in zip(step.column("doc_id").to_pylist(), sets, ends.tolist(), strict=True):
                if doc is None or not len(own) or (key := _digest(own)) in seen:
                    continue
                seen.add(key)
                firsts.append(prefix(own, hot[end - len(own): end], share))
                ids.append(doc)
                sizes.append(len(own))
            if ids:
                n = [len(x) for x in firsts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((np.concatenate(firsts) >> np.uint64(64 - REGION_BITS)).view(np.int64)), pa.array(np.repeat(ids, n)), pa.array(np.repeat(np.array(sizes, np.int32), n)),
                     pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n]))],
                    ["shingle", "doc_id", "n", "pos"])

    members = arrow_map(rows, emit, "shingle long, doc_id long, n int, pos int")
    # Repeated rows of other tasks: a row that comes twice would cancel out of r1 and r2.
    again = F.lag(F.struct("doc_id", "n")).over(Window.partitionBy("shingle").orderBy("doc_id", "n", "pos")).eqNullSafe(F.struct("doc_id", "n"))
    members = members.withColumn("again", again).where("not again").drop("again")
    region = Window.partitionBy("shingle")
    # What follows the place allows partners of so many shingles at most. Of two that link, the
    # smaller one's bound reaches the larger one, so it is not below its own size; who has no
    # such partner within its bound leaves the region.
    most = ((100 + share) * (F.col("n") - F.col("pos")) / share - F.col("n")).alias("most")
    members = members.select("*", most).withColumn(
        "least", F.min(F.when(F.col("most") >= F.col("n"), F.col("n"))).over(region)).where(F.col("most") >= F.col("least"))
    first = F.min(F.struct("pos", "doc_id", "n")).over(region)
    found = members.select(
        "doc_id", "n", "pos", F.count("*").over(region).cast("int").alias("size"), first.alias("first"),
        F.bit_xor(F.xxhash64("doc_id", "n")).over(region).alias("r1"),
        F.bit_xor(F.xxhash64("n", F.lit("second"), "doc_id")).over(region).alias("r2"),
    ).where("size > 1").groupBy("r1", "r2", "size", "doc_id", "n").agg(F.min("pos").alias("pos"), F.min("first").alias("first"))
    return found.select("r1", "r2", "size", "doc_id", "n", "pos", F.col("first.doc_id").alias("pivot"), F.col("first.n").alias("pivot_n"), F.col("first.pos").alias("pivot_pos"))


def positions_allow(n: str, i: str, m: str, j: str, share: int) -> Column:
    """Sets of n and m shingles whose first common one is number i and j may have enough in common."""
    return (100 + share) * F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) >= share * (F.col(n) + F.col(m))


def allowed(rows: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) of rows (a, b, na, nb, sa, sb) whose sketches allow a link, each once."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            apart = [sketch_difference(x.as_py(), y.as_py()) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            good = pa.array((100 + share) * np.array(apart, np.int64) <= (100 - share) * sizes)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    return arrow_map(rows.select("a", "b", "na", "nb", "sa", "sb"), keep, "a long, b long").distinct()


def with_sketches(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Add the size and the sketch of both documents to pairs (a, b)."""
    left = sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(left, "a").join(right, "b")


def measured(pairs: DataFrame, texts: DataFrame, width: int, share: int) -> DataFrame:
    """(a, b, distance, linked) of pairs (a, b), a written table.

    Joins with texts are merge joins whatever the number of pairs, so the cost grows with the input and has no steps.
    """
    chunks = F.ceil(F.col("partners") / PARTNERS)
    placed = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("partners")), "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), chunks).cast("int").alias("chunk"))
    partners = texts.withColumnRenamed("doc_id", "b").join(placed.hint("merge"), "b").select("a", "chunk", "b", "text")
    pivots = texts.withColumnRenamed("doc_id", "a").join(placed.select("a", "chunk").distinct().hint("merge"), "a").select(
        "a", "chunk", F.lit(None).cast("long").alias("b"), "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, own = None, []  # the pivot's sets: one, unless rows share its id
        for step in steps(batches, "text", STEP_BYTES):
            sets = shingle_sets(step.column("text"), width)
            found: list[tuple] = []
            for a, chunk, b, items in zip(step.column("a").to_pylist(), step.column("chunk").to_pylist(), step.column("b").to_pylist(), sets, strict=True):
                if (a, chunk) != place:
                    place, own = (a, chunk), []
                if b is None:
                    own.append(items)
                    continue
                for x in own:
                    both = len(np.intersect1d(x, items, assume_unique=True))
                    either = len(x) + len(items) - both
                    if either:
                        found.append((a, b, 1 - both / either, 100 * both >= share * either and both > 0))
            columns = list(zip(*found, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], ["a", "b", "distance", "linked"])

    together = pivots.unionByName(partners).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return arrow_map(together, compare, "a long, b long, distance double, linked boolean")


def _unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the regions whose documents, but for the pivots so far, are in several components."""
    labelled = members.where("not done").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "label", F.coalesce("component", "doc_id")).drop("component")
    per_label = labelled.groupBy("r1", "r2", "label").agg(F.count("*").alias("many"))
    open_ = per_label.groupBy("r1", "r2").agg(
        F.count("*").alias("labels"), F.sum("many").alias("left"), F.max(F.struct("many", "label"))["label"].alias("largest")).where("labels > 1")
    return labelled.join(open_.drop("labels"), ["r1", "r2"])


def _first_pairs(members: DataFrame, share: int) -> DataFrame:
    """All pairs of small regions, and each larger region's first pivot with its documents."""
    small = members.where(F.col("size") <= SMALL)
    left = small.select("r1", "r2", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("ia"))
    right = small.select("r1", "r2", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("ib"))
    every = left.join(right, ["r1", "r2"]).where((F.col("a") < F.col("b")) & positions_allow("na", "ia", "nb", "ib", share)).select("a", "b")
    star = members.where(
        (F.col("size") > SMALL) & (F.col("doc_id") != F.col("pivot")) & positions_allow("n", "pos", "pivot_n", "pivot_pos", share))
    return every.unionByName(star.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))).distinct()


def _next_pairs(rows: DataFrame, share: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of new pivots with documents of other components, and which rows have been pivots."""
    order = Window.partitionBy("r1", "r2").orderBy("pos", "doc_id")
    chosen = rows.where("label <> largest").withColumn("place", F.row_number().over(order)).where(
        (F.col("left") <= SMALL) | (F.col("place") <= PIVOTS) | F.lit(level >= LEVELS))
    pivots = kept(chosen.select("r1", "r2", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("ia"), F.col("sketch").alias("sa"),
                                F.col("label").alias("la"), F.col("away").alias("aa")), "pivots")
    # Distances to the region's first pivot: by the triangle inequality a link's differ by the threshold at most.
    window = F.coalesce(F.abs(F.col("aa") - F.col("away")) <= 1 - share / 100 + 1e-9, F.lit(True))
    pairs = rows.withColumnsRenamed({"doc_id": "b", "n": "nb", "pos": "ib", "sketch": "sb"}).join(pivots, ["r1", "r2"]).where(
        (F.col("la") != F.col("label")) & positions_allow("na", "ia", "nb", "ib", share) & window)
    return allowed(pairs, share), pivots.select("r1", "r2", F.col("a").alias("doc_id"), F.col("na").alias("n"), F.lit(True).alias("now")).distinct()


def _joined(rows: DataFrame, share: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, d1, d2, sketch) of each row of (doc_id, text), and (node, component) of the linked ids."""
    if not 50 <= share <= 100:
        raise ValueError("share must be between 50 and 100")
    signed = kept(signatures(rows, width), "signatures")
    listed = signed.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")).where(
        F.col("times") >= FREQUENT).orderBy(F.desc("times"), "shingle").limit(LISTED).select("shingle").collect()
    own = signed.where("shingle is null").select("doc_id", "n", "d1", "d2", "sketch")

    # Exact copies: each tied to the smallest id of its digest.
    groups = own.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("high")).where("b <> high")
    copies = own.where("n > 0 and doc_id is not null").join(kept(groups.select("d1", "d2", "b"), "copies"), ["d1", "d2"]).select(
        F.col("doc_id").alias("a"), "b").where("a <> b").distinct()

    frequent = np.array([r[0] for r in listed], np.int64).view(np.uint64)
    members = kept(regions(rows, frequent, width, share), "regions")
    sketched = own.where("doc_id is not null and n > 0")
    sketches = sketched.select("doc_id", "n", "sketch")
    large = members.where(F.col("size") > SMALL)
    pairs = kept(allowed(with_sketches(_first_pairs(members, share), sketches), share), "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).unionByName(large.select("doc_id")).distinct()
    ids = kept(ids, "candidates")
    texts = kept(rows.join(ids.hint("merge"), "doc_id", "left_semi"), "texts")
    found = kept(measured(pairs, texts, width, share), "distances")

    away = found.groupBy("a", "b").agg(F.min("distance").alias("away"))
    away = away.select(F.col("a").alias("pivot"), F.col("b").alias("doc_id"), "away")
    # An id with several texts is no point of the metric: it has no distance to the pivot, and is done text by text.
    several = kept(sketched.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("d1", "d2")]).where(
        "min_d1 <> max_d1 or min_d2 <> max_d2").select("doc_id", F.lit(True).alias("several")), "several")
    of_pivot = several.select(F.col("doc_id").alias("pivot"), F.col("several").alias("pivots"))
    point = F.col("several").isNull() & F.col("pivots").isNull()
    first = (F.col("doc_id") == F.col("pivot")) & point
    rest = kept(large.join(away, ["pivot", "doc_id"], "left").join(sketches, ["doc_id", "n"]).join(several, "doc_id", "left").join(of_pivot, "pivot", "left").select(
        "r1", "r2", "doc_id", "n", "pos", "sketch", F.when(first, 0.0).when(point, F.col("away")).alias("away"), first.alias("done")).distinct(), "regions")
    links = kept(copies.unionByName(found.where("linked").select("a", "b")).distinct(), "links")
    labels = kept(components(links), "components")
    level = 1
    while not (open_rows := kept(_unresolved(rest, labels), "open")).isEmpty():
        level += 1
        pairs, pivots = _next_pairs(open_rows, share, level)
        found = kept(measured(kept(pairs, "pairs"), texts, width, share), "distances")
        # Documents that have met their whole region leave it.
        after = open_rows.drop("done").join(pivots, ["r1", "r2", "doc_id", "n"], "left").select(
            "r1", "r2", "doc_id", "n", "pos", "sketch", "away", F.coalesce("now", F.lit(False)).alias("done"))
        rest, before = kept(after.where("not done"), "regions"), rest
        forget(before)
        forget(open_rows)
        more = found.where("linked").select("a", "b")
        if not more.isEmpty():
            links = kept(links.unionByName(more).distinct(), "links")
            labels = kept(components(links), "components")
    return own, labels


def near_duplicates(
    docs: DataFrame, share: int = 75, width: int = 5, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Two documents link when 100 * intersection >= share * union of their sets;
    ``component_id`` is the smallest id that links reach.
    """
    own, labels = _joined(_texts(docs, doc_id, text), share, width)
    return own.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


# --- all links ------------------------------------------------------------

def _classes(own: DataFrame, labels: DataFrame) -> DataFrame:
    """(d1, d2, n, rep, ids, component): different sets, their smallest id and number of ids."""
    some = own.where("n > 0 and doc_id is not null").select("d1", "d2", "n", "doc_id").distinct()
    classes = some.groupBy("d1", "d2").agg(F.min("n").alias("n"), F.min("doc_id").alias("rep"), F.count("*").alias("ids"))
    return classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _dealt(classes: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """Classes of components of several, with ``band`` and ``chunk``; and (component, band, chunks).

    A component of one chunk has one band. Larger ones are cut by size into bands so
    wide that only classes of the same and of neighbouring bands can link.
    """
    chunks = lambda: F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_SHINGLES)).cast("int")
    whole = classes.groupBy("component").agg(F.count("*").alias("many"), chunks().alias("chunks")).where("many > 1")
    step = max(math.log(100 / share), 0.01) * (1 + 1e-9)
    band = F.when(F.col("chunks") > 1, F.floor(F.log("n") / step)).otherwise(0).cast("int")
    placed = classes.join(whole, "component").withColumn("band", band).withColumn("alone", F.col("chunks") == 1).drop("many", "chunks")
    placed = kept(placed, "classes")
    bands = kept(placed.groupBy("component", "band").agg(chunks().alias("chunks")), "bands")
    return placed.join(bands, ["component", "band"]).withColumn("chunk", F.pmod(F.xxhash64("d1", "d2"), "chunks").cast("int")).drop("chunks"), bands


def linked_sets(a: list[np.ndarray], b: list[np.ndarray] | None, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the linked pairs of two lists of sets, or of one list (first number below the second)."""
    sets = a if b is None else a + b
    sizes = np.array([len(x) for x in sets], np.int64)
    every, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, of = every[order], of[order]
    new = np.concatenate(([True], every[1:] != every[:-1]))
    times = np.diff(np.append(np.flatnonzero(new), len(every)))
    # Shingles of one set alone are in no intersection.
    several = np.repeat(times > 1, times)
    column, of = (np.cumsum(new) - 1)[several], of[several]
    column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1]))) if len(column) else column
    m, first = len(a), 0 if b is None else len(a)
    both = np.zeros((m, len(sets) - first), np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        at = slice(*np.searchsorted(column, [low, low + COLUMNS]).tolist())
        has = np.zeros((len(sets), int(column[at][-1]) - low + 1), np.float32)
        has[of[at], column[at] - low] = 1
        both += np.rint(has[:m] @ has[first:].T).astype(np.int64)
    either = sizes[:m, None] + sizes[None, first:] - both
    found = (both > 0) & (100 * both >= share * either)
    return np.nonzero(np.triu(found, 1) if b is None else found)


def _packed(sets: list[np.ndarray]) -> tuple[bytes, int]:
    found, at = np.unique(np.concatenate(sets), return_inverse=True)
    whole = np.concatenate(([len(sets), len(found)], [len(x) for x in sets], found.view(np.int64), at)).astype(np.int64).tobytes()
    return pa.compress(whole, "zstd", asbytes=True), len(whole)


def _unpacked(value: bytes, size: int) -> list[np.ndarray]:
    whole = np.frombuffer(pa.decompress(value, size, "zstd", asbytes=True), np.int64)
    n, m = int(whole[0]), int(whole[1])
    sizes, found, at = whole[2: 2 + n], whole[2 + n: 2 + n + m].view(np.uint64), whole[2 + n + m:]
    return np.split(found[at], np.cumsum(sizes)[:-1])


def _all_links(rows: DataFrame, own: DataFrame, labels: DataFrame, share: int, width: int, pairs: bool) -> tuple[DataFrame, DataFrame]:
    """The classes, and the links between them: as pairs (a, b) of their smallest ids, or (rep, d1, d2, links) summed in parts.

    A link joins two classes of one component. Each pair of classes meets in one
    task: those of a small component at once, those of a larger one in blocks of
    chunks. So no pair is a row unless pairs are asked for.
    """
    classes = kept(_classes(own, labels), "classes")
    placed, bands = _dealt(classes, share)
    placed = kept(placed, "placed")
    texts = rows.join(placed.hint("merge"), rows["doc_id"] == placed["rep"]).select(
        "component", "band", "chunk", "alone", "rep", "d1", "d2", "ids", "text")
    columns = ["a", "b"] if pairs else ["rep", "d1", "d2", "links"]

    def told(x: tuple, y: tuple | None) -> list[np.ndarray]:
        """Result columns from (reps, d1, d2, ids, sets) of one block or two."""
        i, j = linked_sets(x[4], None if y is None else y[4], share)
        second = x if y is None else y
        if pairs:
            return [np.minimum(x[0][i], second[0][j]), np.maximum(x[0][i], second[0][j])]
        one = np.bincount(i, second[3][j], len(x[0])).astype(np.int64)
        two = np.bincount(j, x[3][i], len(second[0])).astype(np.int64)
        parts = [(x, one + two)] if y is None else [(x, one), (y, two)]
        return [np.concatenate(c) for c in zip(*[(*[v[k][n > 0] for k in range(3)], n[n > 0]) for v, n in parts], strict=True)]

    packed = ["component", "band", "chunk", "reps", "d1s", "d2s", "idss", "sets", "bytes"]
    types = [pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 4, pa.binary(), pa.int64()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, alone, held = None, True, {}

        def finish() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            *ints, sets = zip(*[(*k, *v) for k, v in held.items()], strict=True)
            d1, d2, rep, ids = (np.array(x, np.int64) for x in ints)
            if alone:
                out = told((rep, d1, d2, ids, list(sets)), None)
                n = len(out[0])
                if n:
                    yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in out], *[pa.nulls(n, t) for t in types]], columns + packed)
                return
            value, size = _packed(list(sets))
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(1, pa.int64()) for _ in columns], *[pa.array([v], t) for v, t in zip(
                    [*place, *[x.tolist() for x in (rep, d1, d2, ids)], value, size], types, strict=True)]], columns + packed)

        for step in steps(batches, "text", STEP_BYTES):
            sets = shingle_sets(step.column("text"), width)
            fields = [step.column(c).to_pylist() for c in ("component", "band", "chunk", "alone", "rep", "d1", "d2", "ids")]
            for c, band, chunk, single, rep, d1, d2, ids, items in zip(*fields, sets, strict=True):
                if (c, band, chunk) != place:
                    yield from finish()
                    place, alone, held = (c, band, chunk), single, {}
                # Rows that share an id may have other texts.
                if (d1, d2) not in held and np.frombuffer(_digest(items), "<i8").tolist() == [d1, d2]:
                    held[d1, d2] = (rep, ids, items)
        yield from finish()

    key = ["component", "band", "chunk"]
    schema = ", ".join(f"{c} long" for c in columns)
    first = kept(arrow_map(
        texts.repartition(*key).sortWithinPartitions(*key), pack,
        schema + ", component long, band int, chunk int, reps array<long>, d1s array<long>, d2s array<long>, idss array<long>, sets binary, bytes long"), "links")
    chunks = first.where("component is not null").select(*packed)
    sized = bands.withColumn("blocks", F.ceil(F.col("chunks") / CHUNKS).cast("int")).drop("chunks")
    beside = lambda name, by: sized.select("component", (F.col("band") + by).alias("band"), F.col("blocks").alias(name))
    chunks = chunks.join(beside("same", 0), key[:2]).join(beside("above", -1), key[:2], "left").join(beside("below", 1), key[:2], "left")
    block = F.floor(F.col("chunk") / CHUNKS).cast("int")
    each = lambda n, fn: F.transform(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>")), fn)
    # Places where a chunk meets others: band ``low`` block i with itself (step 0) or the band above (step 1), block j.
    within = each("same", lambda j: F.struct(F.col("band").alias("low"), F.lit(0).alias("step"), F.least(block, j).alias("i"), F.greatest(block, j).alias("j"), (block > j).cast("int").alias("side")))
    over = each("above", lambda j: F.struct(F.col("band").alias("low"), F.lit(1).alias("step"), block.alias("i"), j.alias("j"), F.lit(0).alias("side")))
    under = each("below", lambda i: F.struct((F.col("band") - 1).alias("low"), F.lit(1).alias("step"), i.alias("i"), block.alias("j"), F.lit(1).alias("side")))
    met = chunks.select("component", F.explode(F.concat(within, over, under)).alias("m"), *packed[3:]).select("component", "m.*", *packed[3:])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sides = None, ([], [])

        def block_of(side: list) -> tuple:
            return (*[np.concatenate([v[k] for v in side]) for k in range(4)], [x for v in side for x in v[4]])

        def finish() -> Iterator[pa.RecordBatch]:
            one, two = sides
            alone = place is not None and place[2] == 0 and place[3] == place[4]
            if one and (two or alone):
                out = told(block_of(one), None if alone else block_of(two))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], columns)

        for step in steps(batches, "sets", STEP_BYTES):
            for r in step.to_pylist():
                if (now := (r["component"], r["low"], r["step"], r["i"], r["j"])) != place:
                    yield from finish()
                    place, sides = now, ([], [])
                sides[r["side"]].append((*[np.array(r[c], np.int64) for c in packed[3:7]], _unpacked(r["sets"], r["bytes"])))
        yield from finish()

    at = ["component", "low", "step", "i", "j"]
    second = arrow_map(met.repartition(*at).sortWithinPartitions(*at), compare, schema)
    return classes, first.where("component is null").select(*columns).unionByName(second)


def counted_links(
    docs: DataFrame, share: int = 75, width: int = 5, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document.

    ``n_links`` is the number of other documents that it links to, exact copies
    included. Rows with the same id and set are one document; an id counts once
    for each of its different sets.
    """
    rows = _texts(docs, doc_id, text)
    own, labels = _joined(rows, share, width)
    classes, found = _all_links(rows, own, labels, share, width, pairs=False)
    summed = found.groupBy("rep", "d1", "d2").agg(F.sum("links").alias("links"))
    total = classes.join(summed, ["rep", "d1", "d2"], "left").select(
        "d1", "d2", F.col("component").alias("of_set"), (F.coalesce("links", F.lit(0)) + F.col("ids") - 1).alias("links"))
    # Sets without shingles and rows without an id link with nothing.
    return own.join(total, ["d1", "d2"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("of_set", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def link_pairs(
    docs: DataFrame, share: int = 75, width: int = 5, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(a, b) of all links between different sets, each named by the smallest id that has it, a <= b.

    Each pair of sets is there once. Ids with the same set link too; they are not listed.
    """
    rows = _texts(docs, doc_id, text)
    own, labels = _joined(rows, share, width)
    return _all_links(rows, own, labels, share, width, pairs=True)[1]
