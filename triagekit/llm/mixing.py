"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree
[DataFrame functions only].

1. Targets.  Sources in code-point order weigh ``weights`` in turn and share
   ``share`` of all words; a target stops at ``max_epochs`` times its source and the
   excess is shared again by weight until none is above.
2. Tapes.  The documents of a source lie one after another on a tape in hashed order;
   an epoch is one run over the tape, the last epoch stops at the target.  Tapes are
   cut into blocks of ``block_words``; a document belongs to the block its first word
   lies in.
3. Tree.  The blocks each source contributes (its quota) are split over the output
   shards by halving the shards: at every node the left half draws its exact number of
   blocks without replacement, source after source, from what the node has
   (hypergeometric, conditional on what earlier sources drew).
4. Draw.  Block numbers of a source are permuted (affine map modulo their count) and
   every shard takes the next ``quota`` of them, so shards are disjoint and cover all.
5. Rows of a shard are shuffled locally by a hash of document and epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.indexing import running_sum, with_sequential_index
from .common import shared_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
SHARDS = 16
BLOCK_WORDS = 4096
#: Sources beyond so many share a colour of the tree (blocks inside a colour are
#: permuted together); it bounds the arrays of the tree, not the sources.
COLOURS = 1024
#: Documents per cell of a tape's running sum.
CELL_ROWS = 50_000
#: Primes above any block count, so that ``i -> (i * p + c) mod n`` permutes; the first one
#: that is neither 1 nor -1 modulo n is taken (for n of 1, 2, 3, 4 and 6 there is none).
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587)
SEED = "mix-1"


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share_percent=SHARE_PERCENT,
                   max_epochs=MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> plus rank, weight, target (double).

    Only scalars reach the driver: one pair of sums per round of sharing.
    """
    s = with_sequential_index(sizes, [F.col("source").asc_nulls_last()], "rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.col("rank") % len(weights) + 1).cast("int"))
    s = shared_table(s.withColumn("weight", w), "mix-sources")
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * share_percent / 100.0
    cap = F.col("source_size") * float(max_epochs)
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > cap if level else F.col("source_size") < 0
        r = s.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("cap"),
                  F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("w"),
                  F.coalesce(F.sum(over.cast("long")), F.lit(0)).alias("n")).first()
        if r.n == capped or not r.w or total <= 0:
            break
        level, capped = (total - r.cap) / r.w, r.n
    return s.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def hypergeometric(marked, total, drawn, u):
    """Inverse of the hypergeometric distribution function at ``u`` in [0, 1).

    Outcome weights follow from ratios of neighbours, walking upwards through ten
    standard deviations (and ten steps) around the mode; what lies outside is below
    1e-20 of the whole.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rest = total - marked
    low, high = F.greatest(zero, drawn - rest), F.least(marked, drawn)
    mode = F.floor((drawn + 1.0) * (marked + 1.0) / (total + 2.0)).cast("long")
    mode = F.least(high, F.greatest(low, mode))
    size = F.greatest(total, one)
    variance = (drawn * (marked / size) * (rest / size)
                * ((total - drawn) / F.greatest(total - one, one)))
    reach = F.ceil(F.sqrt(F.greatest(variance, F.lit(0.0))) * 10.0).cast("long") + 10
    first, last = F.greatest(low, mode - reach), F.least(high, mode + reach)
    steps = F.when(first < last, F.sequence(first, F.greatest(first, last - 1))).otherwise(
        F.array().cast("array<bigint>"))

    def ratio(k):  # weight of k + 1 over weight of k
        return ((marked - k) * 1.0) * (drawn - k) / ((k + 1.0) * (rest - drawn + k + 1))

    mass = F.aggregate(
        steps, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("t")),
        lambda s, k: F.struct((s["w"] * ratio(k)).alias("w"), (s["t"] + s["w"] * ratio(k)).alias("t")),
        lambda s: s["t"])
    goal = u * mass
    return F.aggregate(
        steps, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("t"), goal.alias("goal"),
                        first.alias("x")),
        # The answer is the first k whose running sum passes the goal.
        lambda s, k: F.struct(
            (s["w"] * ratio(k)).alias("w"), (s["t"] + s["w"] * ratio(k)).alias("t"), s["goal"].alias("goal"),
            F.when(s["t"] <= s["goal"], k + 1).otherwise(s["x"]).alias("x")),
        lambda s: s["x"])


def split_quotas(colours: DataFrame, shards: int) -> DataFrame:
    """(colour, quota) -> (colour, ends): where each shard's share of the colour's
    permuted blocks ends.  One row per node of the tree, one array entry per colour."""
    node = colours.groupBy().agg(F.sort_array(F.collect_list(F.struct("colour", "quota"))).alias("q"))
    node = node.select(F.lit(0).alias("first"), F.lit(shards).alias("n"),
                       F.transform("q", lambda e: e["colour"]).alias("ids"),
                       F.transform("q", lambda e: e["quota"]).alias("q"))
    depth = max(0, (shards - 1).bit_length())
    for _ in range(depth):
        half = F.floor(F.col("n") / 2).cast("long")
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        goal = F.floor(total * half / F.col("n")).cast("long")

        def draw(acc, e):
            u = F.pmod(F.xxhash64(F.lit(SEED), F.col("first"), F.col("n"), e["i"]), F.lit(1 << 52)) / float(1 << 52)
            x = hypergeometric(e["k"], acc["left"], acc["goal"], u)
            return F.struct(F.concat(acc["xs"], F.array(x)).alias("xs"),
                            (acc["left"] - e["k"]).alias("left"), acc["goal"].alias("goal"))

        # acc: draws so far, blocks the node has left, draws still to make.
        marked = F.transform("q", lambda k, i: F.struct(k.alias("k"), i.alias("i")))
        start = F.struct(F.array().cast("array<bigint>").alias("xs"), total.alias("left"), goal.alias("goal"))

        def step(acc, e):
            drawn = draw(acc, e)
            return drawn.withField("goal", acc["goal"] - F.element_at(drawn["xs"], -1))

        node = node.withColumn("l", F.when(F.col("n") > 1, F.aggregate(marked, start, step, lambda a: a["xs"])))
        left = F.struct(F.col("first"), half.cast("int").alias("n"), F.col("ids"), F.col("l").alias("q"))
        right = F.struct((F.col("first") + half).cast("int").alias("first"),
                         (F.col("n") - half).cast("int").alias("n"), F.col("ids"),
                         F.zip_with("q", "l", lambda a, b: a - b).alias("q"))
        same = F.struct("first", "n", "ids", "q")
        node = node.select(F.inline(F.when(F.col("n") > 1, F.array(left, right)).otherwise(F.array(same))))
    flat = node.select(F.col("first").alias("shard"), F.explode(F.arrays_zip("ids", "q")).alias("e")).select(
        "shard", F.col("e.ids").alias("colour"), F.col("e.q").alias("quota"))
    per = flat.groupBy("colour").agg(F.sort_array(F.collect_list(F.struct("shard", "quota"))).alias("s"))
    ends = F.transform(F.sequence(F.lit(1), F.size("s")), lambda j: F.aggregate(
        F.slice("s", 1, j), F.lit(0).cast("long"), lambda a, x: a + x["quota"]))
    return per.select("colour", ends.alias("ends"))


def mix_documents(docs: DataFrame, shards: int = SHARDS, size=None, id_col: str = "doc_id",
                  source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``mix``, a struct of

    size, source_size, target, taken (words over all epochs) and ``pieces``: one entry
    per epoch that takes words of the row, (epoch, words, shard, order).  A shard's
    rows are its pieces sorted by ``order``.

    Null or empty texts have size 0 and no pieces; a null source is a source of its
    own; repeated rows count each; an empty table gives an empty result.  A column of
    the input called ``mix`` is replaced; others may have any name.
    """
    keep = [c for c in docs.columns if c != "mix"]
    size = word_count(F.col(text_col)) if size is None else size
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(source_col).alias("source"),
                    F.md5(F.concat(F.lit(SEED + "|"), ident).cast("binary")).alias("key"),
                    ident.alias("ident"), size.alias("size"))
    sums = shared_table(d.groupBy("source").agg(F.sum("size").alias("source_size"),
                                                F.count(F.lit(1)).alias("n")), "mix-sizes")
    rows = sums.agg(F.sum("n")).first()[0] or 0
    s = source_targets(sums.select("source", "source_size"))
    words = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    wanted = s.agg(F.sum(words)).first()[0] or 0
    block = max(BLOCK_WORDS, -(-wanted // (1 << 30)))  # keeps block numbers below the primes
    s = (s.withColumn("epochs", epochs)
         .withColumn("part", words - F.col("epochs") * F.col("source_size"))
         .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
         .withColumn("quota", F.col("epochs") * F.col("blocks") + F.ceil(F.col("part") / block).cast("long"))
         .withColumn("colour", F.col("rank") % COLOURS))
    per_colour = Window.partitionBy("colour")
    s = (s.withColumn("base", F.sum("quota").over(per_colour.orderBy("rank")) - F.col("quota"))
         .withColumn("colour_quota", F.sum("quota").over(per_colour)))
    s = shared_table(s, "mix-quotas")
    ends = split_quotas(s.groupBy("colour").agg(F.sum("quota").alias("quota")), shards)
    s = shared_table(s.join(ends, "colour"), "mix-plan")

    known = s.withColumn("named", F.col("source").isNotNull()).withColumn(
        "source", F.coalesce("source", F.lit(""))).drop("weight", "quota", "colour")
    d = d.withColumn("named", F.col("source").isNotNull()).withColumn("source", F.coalesce("source", F.lit("")))
    d = d.join(known, ["source", "named"])
    digits = 1
    while 16 ** digits * CELL_ROWS < rows and digits < 8:
        digits += 1
    d = running_sum(d, ["rank"], ["key", "ident", "size"], "size", F.substring("key", 1, digits), "upto")
    start = F.col("upto") - F.col("size")
    cut = F.least(F.greatest(F.col("part") - start, F.lit(0).cast("long")), F.col("size"))

    # A permutation of the colour's blocks: a prime that moves them, and where it begins.
    n = F.greatest(F.col("colour_quota"), F.lit(1).cast("long"))
    factor = F.lit(PRIMES[-1])
    for prime in PRIMES[-2::-1]:
        factor = F.when((F.lit(prime) % n).isin(F.lit(0), F.lit(1), n - 1), factor).otherwise(F.lit(prime))
    offset = F.pmod(F.xxhash64(F.lit(SEED), F.lit("offset"), F.col("rank") % COLOURS), n)

    def piece(e):
        index = F.col("base") + e * F.col("blocks") + F.floor(start / block).cast("long")
        rank = F.pmod(index * factor + offset, n)
        return F.struct(
            e.cast("int").alias("epoch"), F.when(e < F.col("epochs"), F.col("size")).otherwise(cut).alias("words"),
            F.size(F.filter("ends", lambda x: x <= rank)).alias("shard"),
            F.xxhash64(F.lit(SEED), F.col("key"), e).alias("order"))

    pieces = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("epochs")), piece),
                      lambda p: p["words"] > 0)
    d = d.withColumn("pieces", pieces)
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return d.select("row.*", F.struct("size", "source_size", "target", taken.alias("taken"), "pieces").alias("mix"))


def mix_digest(docs: DataFrame) -> DataFrame:
    """The mix per document, from a narrow table: texts are read once, for their sizes."""
    narrow = shared_table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-docs")
    out = mix_documents(narrow, size=F.col("size"))
    return out.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken",
                      F.size("mix.pieces").alias("n_pieces"),
                      F.transform("mix.pieces", lambda p: p["shard"]).alias("shards"))


def mix_rows(docs: DataFrame) -> DataFrame:
    """The mixed corpus: one row of ``docs`` per piece, whole documents only.

    The one document per source that the target cuts is taken whole if at least half
    of it lies inside, else left out.  Rows lie in files by shard, in local shuffle order.
    Null, empty and blank texts are in no mix; repeated rows count each; an empty table
    stays empty; columns may have any name.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), "doc_id", "source",
                       word_count(F.col("text")).alias("size"))
    p = mix_documents(rows, size=F.col("size")).select("own", "mix.size", F.explode("mix.pieces").alias("piece"))
    p = p.where(F.col("piece.words") * 2 >= F.col("size"))
    return (p.repartition(F.col("piece.shard"), F.pmod("piece.order", F.lit(64)))
            .sortWithinPartitions("piece.shard", "piece.order").select(*[F.col(f"own.`{c}`").alias(c) for c in docs.columns]))
