"""MinHash near-dedup: SuperMinHash signatures, banding, verification, union-find.

A document is the set of its distinct five-word shingles.  Documents with equal sets
are one node from the start.  Nodes that agree in a whole band of their signature are
candidates; links are confirmed on the full sets, in two rounds that never emit the
pairs of a bucket:

1. Every member of a bucket is compared with the bucket's smallest member.  Confirmed
   links are joined into components.
2. Only buckets that still hold several components are compared further.  As long as
   their pairs outnumber their members by far, members outside the smallest member's
   component are compared with one member of it and with one of each other, others in each
   turn, and components are joined again: linear work that connects most of a large group
   of copies that drift apart.
3. What is still apart is compared exhaustively: the outsiders with all members, in pairs
   of blocks; a task leaves out pairs that are already connected.

After that every candidate pair is either connected or was compared, so the components
are those of all confirmed candidate pairs.  op3 links from 0.85 up: with 24 bands of 5
slots a pair at the threshold shares no band with probability 8e-7 (less above it).  The
pipeline's stage links from 0.8 up, with 40 bands: 1.3e-7.  Sets are named by 64 bits;
two of a billion different sets share a name with probability 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import maybe_broadcast
from .common import (FOLD, bound_batches, mix64, rounds, shared_table, span_hashes, window_hashes,
                     word_spans)
from .components import components
from .substring_dedup import text_key
from .superminhash import signatures

WIDTH = 5
PERCENT = 85
BANDS, ROWS = 24, 5
#: The pipeline's stage: a similarity of 0.8 or more.
STAGE_PERCENT, STAGE_BANDS = 80, 40
#: Members of one block of a bucket in the last round.
BLOCK = 512
#: Turns of linear work at most; the rows of the last round, as a multiple of the members
#: of all buckets, that are worth another turn; and what a turn must leave of them to be
#: followed by another.
TURNS, WORTH, PROGRESS = 6, 8, 0.6


def shingle_sets(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' distinct shingles, borders by text)."""
    flat = FOLD[flat]
    starts, ends, first = word_spans(flat, offsets)
    words = span_hashes(flat, starts, ends)
    full = window_hashes(words, WIDTH)
    out, border = [], np.zeros(len(first), np.int64)
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= WIDTH:
            u = np.unique(full[a:b - WIDTH + 1])
        elif b > a:  # fewer words: the whole sequence, apart from windows of other widths
            u = window_hashes(words[a:b], int(b - a)) ^ np.uint64(b - a)
        else:
            u = full[:0]
        out.append(u)
        border[i + 1] = border[i] + len(u)
    return np.concatenate(out) if out else full[:0], border


def set_names(elements: np.ndarray, border: np.ndarray) -> np.ndarray:
    """64-bit name per set, from its elements in any order."""
    total = np.zeros(len(elements) + 1, np.uint64)
    np.cumsum(mix64(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=total[1:])
    return mix64(total[border[1:]] - total[border[:-1]] + np.diff(border).astype(np.uint64))


def _sketch(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, flat, offsets in rounds(batch, "text"):
                elements, border = shingle_sets(flat, offsets)
                sig = signatures(elements, border, bands * ROWS).astype(np.uint64).reshape(-1, bands, ROWS)
                key = np.tile(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), 1))
                for j in range(ROWS):
                    key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + sig[:, :, j])
                keep = np.diff(border) > 0
                key = key[keep]
                at = np.concatenate([[0], np.cumsum(np.where(keep, bands, 0))])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("t"), rows.column("u"), pa.array(np.diff(border)),
                     pa.array(set_names(elements, border).view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(key.reshape(-1).view(np.int64)))],
                    names=["doc_id", "t", "u", "n_shingles", "set_id", "bands"])
    return run


def full_set(text: str) -> set:
    w = text.encode().lower().split()
    if len(w) < WIDTH:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(WIDTH))))


def linked(a: set, b: set, percent: int = PERCENT) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, set()
        for batch in batches:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            texts, hubs = batch.column("text"), batch.column("hub_text")
            keep = []
            for i in range(batch.num_rows):
                if v[i] != last:
                    last, hub = v[i], full_set(hubs[i].as_py())
                keep.append(linked(full_set(texts[i].as_py()), hub, percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], ["u", "v"])
    return run


def _new_links(rows: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links between outsiders and members of one pair of blocks that join something.

    One array pass per outsider counts its shingles in all members; pairs that are
    connected already are left out.
    """
    members = sorted({r["set_id"]: r for r in rows if not r["outsider"]}.values(), key=lambda r: r["set_id"])
    outsiders = sorted({r["set_id"]: r for r in rows if r["outsider"]}.values(), key=lambda r: r["set_id"])
    if not members or not outsiders:
        return []
    number: dict[tuple, int] = {}
    sets = [[number.setdefault(x, len(number)) for x in full_set(r["text"])] for r in members]
    size = np.array([len(x) for x in sets])
    flat, first = np.concatenate([np.array(x, np.int64) for x in sets]), np.cumsum(size) - size
    roots = [r["root"] for r in members]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    mark = np.zeros(len(number), bool)
    for o in outsiders:
        own = full_set(o["text"])
        mine = np.array([number[x] for x in own if x in number], np.int64)
        mark[mine] = True
        both = np.add.reduceat(mark[flat].astype(np.int64), first)
        mark[mine] = False
        for i in np.flatnonzero(100 * both >= percent * (size + len(own) - both)).tolist():
            if find(roots[i]) != find(o["root"]):
                parent[find(roots[i])] = find(o["root"])
                out.append((o["set_id"], members[i]["set_id"]))
    return out


def _confirm_blocks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (key, i, j): each group holds one block of outsiders, one of members."""
        held: list[dict] = []
        out: list[tuple[int, int]] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["key"], r["i"], r["j"]) != (held[0]["key"], held[0]["i"], held[0]["j"]):
                    out += _new_links(held, percent)
                    held = []
                held.append(r)
        out += _new_links(held, percent) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])
    return run


def _apart(members: DataFrame, roots: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(members with their roots, and whether that is not their hub's; buckets that still
    hold several components, with one member of the hub's and one outsider, by ``turn``)."""
    m = members.join(roots, F.col("set_id") == F.col("node"), "left").select(
        "key", "set_id", "hub", F.coalesce("root", "set_id").alias("root"))
    hub_root = m.where("set_id = hub").select("key", F.col("root").alias("hub_root"))
    m = shared_table(m.join(hub_root, "key").withColumn("outsider", F.col("root") != F.col("hub_root")), "rooted")
    lot = F.struct(F.xxhash64("set_id", F.lit(turn)).alias("h"), "set_id", "root")
    state = m.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("set_id")).alias("who"),
        F.sum(F.col("outsider").cast("int")).alias("out"),
        F.min(F.when(~F.col("outsider"), lot)).alias("near"), F.min(F.when(F.col("outsider"), lot)).alias("far"))
    # Two members were compared already; buckets with the same members count once.
    state = state.where("out > 0 and n > 2").groupBy("who", "n").agg(
        F.min(F.struct("key", "out", "near", "far")).alias("one")).select(
        "one.key", "n", "one.out", F.col("one.near.set_id").alias("near"), "one.far",
        F.ceil(F.col("one.out") / BLOCK).cast("int").alias("ob"), F.ceil(F.col("n") / BLOCK).cast("int").alias("mb"))
    return m, shared_table(state, "apart")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after more links: components of the roots alone are joined."""
    a = roots.select(F.col("node").alias("u"), F.col("root").alias("ru"))
    b = roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
    between = links.join(a, "u", "left").join(b, "v", "left").select(
        F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")).where("u <> v").distinct()
    joined = shared_table(components(shared_table(between, "between")), "joined")
    moved = roots.join(joined.select(F.col("node").alias("old"), F.col("root").alias("new")), F.col("root") == F.col("old"), "left")
    alone = joined.join(roots.select("node"), "node", "left_anti")
    return shared_table(moved.select("node", F.coalesce("new", "root").alias("root")).unionByName(alone), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """Per row: doc_id, t, u (names of the text), n_shingles, set_id, root (one set of the
    component), component_id (smallest id reachable).

    Links are pairs of a similarity of ``percent`` or more.
    A null, empty or blank text has no shingle and is linked with nothing; its
    component is its own id.  Repeated rows are one node, rows of one id with different
    texts one document.  Null ids are never the smallest unless a component has no
    other.  An empty table gives an empty result; only the two named columns are read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_key(F.col(text_col)), F.col(text_col).alias("text"))
    sketch = shared_table(d.mapInArrow(
        _sketch(bands), "doc_id long, t long, u long, n_shingles long, set_id long, bands array<long>"), "sketch")
    filled = sketch.where("n_shingles > 0")
    sets = filled.groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min(F.struct("doc_id", "t", "u")).alias("one"))

    # Buckets with at least two different sets, and their members.
    banded = filled.select(F.explode("bands").alias("key"), "set_id")
    buckets = banded.groupBy("key").agg(F.min("set_id").alias("hub"), F.max("set_id").alias("top")).where("hub <> top")
    members = shared_table(banded.join(buckets.select("key", "hub"), "key").distinct(), "members")
    stars = members.where("set_id <> hub").select(F.col("set_id").alias("u"), F.col("hub").alias("v")).distinct()

    # Texts of all candidates, once per set: one row's id and text name it (ids may be null or repeat).
    wanted = shared_table(members.select("set_id").distinct().join(sets, "set_id").select(
        "set_id", "n_shingles", F.col("one.doc_id").alias("__id"), F.col("one.t").alias("__t"), F.col("one.u").alias("__u")),
        "wanted")
    texts = d.join(maybe_broadcast(wanted), d["doc_id"].eqNullSafe(F.col("__id")) & (F.col("t") == F.col("__t"))
                   & (F.col("u") == F.col("__u"))).select("set_id", "n_shingles", "text")
    texts = shared_table(texts, "texts")
    if texts.count() > wanted.count():  # repeated rows
        texts = shared_table(texts.dropDuplicates(["set_id"]), "texts")

    def with_texts(pairs: DataFrame) -> DataFrame:
        return (pairs.join(texts.select(F.col("set_id").alias("u"), "text"), "u")
                .join(texts.select(F.col("set_id").alias("v"), F.col("text").alias("hub_text")), "v")
                .select("u", "v", "text", "hub_text"))
    # Texts under one id are one document.
    per_id = filled.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("set_id").alias("v"), F.max("set_id").alias("top")).where("v <> top").select("doc_id", "v")
    one_id = filled.join(per_id, "doc_id").select(F.col("set_id").alias("u"), "v").where("u <> v")
    links = with_texts(stars).mapInArrow(_confirm(percent), "u long, v long").unionByName(one_id).distinct()
    links = shared_table(links, "stars")
    roots = shared_table(components(links), "roots")

    # Buckets in which pairs are left that were not compared.
    total, before = members.count(), None
    for turn in range(TURNS + 1):
        m, state = _apart(members, roots, turn)
        rows = state.agg(F.sum(F.col("n") * F.col("ob") + F.col("out") * F.col("mb"))).first()[0] or 0
        if turn == TURNS or rows <= WORTH * total or (before is not None and rows > PROGRESS * before):
            break
        before = rows
        outside = m.where("outsider").join(state.select("key", "near", "far"), "key")
        turn_pairs = outside.select(F.col("set_id").alias("u"), F.col("near").alias("v")).unionByName(
            outside.where(F.col("root") != F.col("far.root")).select(F.col("set_id").alias("u"), F.col("far.set_id").alias("v")))
        found = shared_table(with_texts(turn_pairs.distinct()).mapInArrow(_confirm(percent), "u long, v long"), "turn")
        if not found.limit(1).count():
            break
        roots = _joined(roots, found)
    m = m.join(state, "key")
    place = F.xxhash64("set_id", F.lit(7))
    rows = m.select("key", "set_id", "root", F.lit(False).alias("outsider"),
                    F.explode(F.sequence(F.lit(0), F.col("ob") - 1)).alias("i"),
                    F.pmod(place, F.col("mb")).cast("int").alias("j"))
    rows = rows.unionByName(m.where("outsider").select(
        "key", "set_id", "root", "outsider", F.pmod(place, F.col("ob")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("j")))
    rest = rows.join(texts.select("set_id", "text"), "set_id").repartition("key", "i", "j")
    more = rest.sortWithinPartitions("key", "i", "j").mapInArrow(_confirm_blocks(percent), "u long, v long").distinct()
    more = shared_table(more, "blocks")
    if more.limit(1).count():
        roots = _joined(roots, more)

    s = sets.join(roots, F.col("set_id") == F.col("node"), "left").select(
        "set_id", "rep", F.coalesce("root", "set_id").alias("root"))
    lowest = s.groupBy("root").agg(F.min("rep").alias("component_id"))
    s = s.join(lowest, "root").select("set_id", "root", "component_id")
    with_set = filled.select("doc_id", "t", "u", "n_shingles", "set_id").join(s, "set_id")
    none = F.lit(None).cast("long")
    without = sketch.where("n_shingles = 0").select(
        "doc_id", "t", "u", "n_shingles", none.alias("set_id"), none.alias("root"), F.col("doc_id").alias("component_id"))
    return with_set.select(*without.columns).unionByName(without)


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    d = near_duplicates(docs)
    return d.select("doc_id", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             percent: int = STAGE_PERCENT, bands: int = STAGE_BANDS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, and every row without words.

    Null, empty and blank texts all stay; repeated rows are one document; of ties the
    smallest id stays, of a group without ids one text; an empty table stays empty; columns
    may have any name.
    """
    d = near_duplicates(docs, id_col, text_col, percent, bands).where("set_id is not null")
    name = [F.col("doc_id").alias("__id"), F.col("t").alias("__t"), F.col("u").alias("__u")]
    # Rows without an id are told apart by their texts; of a component without any id one text stays.
    nameless = d.where("doc_id is null").select("t", "u", "root", "component_id").distinct()
    stays = nameless.where("component_id is null").groupBy("root").agg(F.min(F.struct("t", "u")).alias("one"))
    gone = nameless.join(stays, "root", "left").where(
        F.col("component_id").isNotNull() | (F.struct("t", "u") != F.col("one")))
    zero = F.lit(0).cast("long")
    dropped = d.where("doc_id <> component_id").select(name[0], zero.alias("__t"), zero.alias("__u")).distinct()
    dropped = shared_table(dropped.unionByName(gone.select(F.lit(None).cast("long").alias("__id"), *name[1:])), "dropped")
    text, ident, wordy = F.col(f"row.`{text_col}`"), F.col("ident"), F.col("wordy")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("ident"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("wordy"))
    t, u = (F.when(ident.isNull(), c).otherwise(zero) for c in text_key(text))
    rest = rows.join(maybe_broadcast(dropped), wordy & ident.eqNullSafe(F.col("__id")) & (t == F.col("__t"))
                     & (u == F.col("__u")), "left_anti")
    if rows.where(wordy).groupBy("ident").count().where("count > 1").limit(1).count():
        # Rows of one id are one document: of a kept one the row with the smallest text stays.
        w = Window.partitionBy("ident", "wordy", F.when(ident.isNull() | ~wordy, text)).orderBy(text.asc_nulls_last())
        rest = rest.withColumn("n", F.row_number().over(w)).where((F.col("n") == 1) | ~wordy)
    return rest.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
