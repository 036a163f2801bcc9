"""The prefix trie of conversations, by partition refinement.

All conversations start as one class. A round splits the active classes by their members' next turns and names each new class by its
smallest member; a class of one is retired, and its tail becomes a chain of unary nodes that needs no further look. Rounds
take 1, 2, 4, ... turns at once, up to STRIDE: inside a round a class is split turn by turn on the digest of its turns so
far, so rounds are about log2(STRIDE) + depth / STRIDE for the deepest prefix that two conversations share. At the end the
result is folded back: children, leaves and saved characters of a node are sums over its members, each node and leaf being
counted by the conversation that names it.

Only narrow rows move: conversation, position, a 128-bit digest of role and text, the text's length. A common first turn or
a group of copies is a hot class: its members are added up in the tasks before they are shuffled, and their rows find
their new class by a broadcast of classes (up to BROADCAST of them) or a join that Spark can split. The ids that end at a
node are packed, PACK neighbouring ids to a row, before one task hashes them in order, holding a row at a time.

Null roles and texts count as empty; null turns come first; rows of one turn are ordered by role and by a hash of the text.
Rows with a null conv_id belong to no conversation and are left out. Repeated rows are turns of their own. An empty table
gives no nodes, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, materialize, small_batches

#: Turns of one round at most (the members of an array of 20 bytes each).
STRIDE = 1024
#: Classes (40 bytes each) that are broadcast to their members at most.
BROADCAST = 200_000
#: Ids that end at a node, side by side in a row.
PACK = 4096


def turns(convs: DataFrame) -> DataFrame:
    """conv, pos (from 1), key (digest of role and text), chars of each row with a conv_id, in order of turn (nulls first)."""
    small_batches(convs.sparkSession)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.substring(F.unhex(F.sha2(F.concat(F.length(plain("role")).cast("string"), F.lit(":"), plain("role"), plain("text")), 256)), 1, 16)
    rows = convs.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), plain("role").alias("role"), F.sha2(plain("text"), 256).alias("hash"), key.alias("key"), F.length(plain("text")).cast("long").alias("chars"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "hash")
    return rows.select("conv", F.row_number().over(order).cast("long").alias("pos"), "key", "chars")


def rebuilt(rows: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of the one at the next lower multiple of `every`; h: crc32 of the id modulo most + 1.

    Takes a written table of `turns`; gives (conv, n) of every conversation and the new turns.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    convs = rows.groupBy("conv").agg(F.max("pos").alias("own")).select("conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    first = rows.where((F.col("conv") % every == 0) & (F.col("pos") <= most)).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "chars"))).alias("head"))
    both = convs.join(first.select(F.col("conv").alias("base"), "head"), "base", "left").withColumn("head", F.expr("slice(coalesce(head, array()), 1, int(h))"))
    convs = materialize(both.select("conv", "h", "head", F.size("head").cast("long").alias("taken"), (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("n")))
    heads = convs.select("conv", F.inline("head"))
    own = rows.join(convs.select("conv", "h", "taken"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "chars")
    return convs.select("conv", "n"), heads.unionByName(own)


def strides(rows: DataFrame) -> DataFrame:
    """A written table: conv, round, part array<struct<pos, chain, before, chars>>: a round's turns, each with the digest of all up to it."""
    rounds = F.when(F.col("pos") < STRIDE, F.length(F.bin("pos")) - 1).otherwise((10 + F.floor((F.col("pos") - STRIDE) / STRIDE)).cast("int"))
    parts = rows.groupBy("conv", rounds.alias("round")).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "chars"))).alias("part"))
    empty = F.expr("cast(array() as array<struct<pos:bigint,chain:binary,before:binary,chars:bigint>>)")
    start = F.struct(F.lit(b"").alias("chain"), empty.alias("out"))

    def link(acc, x):
        chain = F.substring(F.unhex(F.sha2(F.concat(acc["chain"], x["key"]), 256)), 1, 16)
        one = F.struct(x["pos"].alias("pos"), chain.alias("chain"), acc["chain"].alias("before"), x["chars"].alias("chars"))
        return F.struct(chain.alias("chain"), F.concat(acc["out"], F.array(one)).alias("out"))

    return materialize(parts.select("conv", "round", F.aggregate("part", start, link, lambda acc: acc["out"]).alias("part")))


def refine(convs: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (conv, depth, label, n, chars) of all classes of two or more, and of the root; label: the smallest member.

    convs (conv, ...) and parts (of `strides`) are written tables. Returns the members and what to forget.
    """
    root = convs.agg(F.min("conv").alias("label"), F.count("*").alias("n"))
    everyone = convs.select("conv").crossJoin(F.broadcast(root))  # one row
    members = [materialize(everyone.select("conv", F.lit(0).cast("long").alias("depth"), "label", "n", F.lit(0).cast("long").alias("chars")))]
    active, k = members[0].select("conv", F.col("label").alias("in_class")), 0
    while True:
        now = active.join(parts.where(F.col("round") == k).select("conv", "part"), "conv").select("conv", "in_class", F.inline("part"))
        classes = now.groupBy("in_class", "pos", "chain").agg(F.min("conv").alias("label"), F.count("*").alias("n")).where("n > 1")
        classes = materialize(classes)
        few = classes.limit(BROADCAST + 1).count() <= BROADCAST
        found = now.join(F.broadcast(classes) if few else classes, ["in_class", "pos", "chain"])
        found = materialize(found.select("conv", F.col("pos").alias("depth"), "label", "n", "chars"))
        forget(classes)
        last = (1 << (k + 1)) - 1 if k < 10 else STRIDE * (k - 9) + STRIDE - 1
        active = found.where(F.col("depth") == last).select("conv", F.col("label").alias("in_class"))
        members.append(found)
        k += 1
        if active.isEmpty():
            break
    out = members[0]
    for m in members[1:]:
        out = out.unionByName(m)
    return out, members


def ends(at: DataFrame) -> DataFrame:
    """depth, label, ends_sha256: the digest of the ids (conv, distinct in a class) in order, comma-joined."""
    bucket = F.floor(F.col("conv") / PACK)
    packed = at.groupBy("depth", "label", bucket.alias("bucket")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    packed = packed.select("depth", "label", "bucket", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    packed = packed.repartition("depth", "label").sortWithinPartitions("depth", "label", "bucket").select("depth", "label", "ids")

    def run(batches):
        last, h, done = None, None, []
        for batch in batches:
            for d, c, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (d, c) != last:
                    if h:
                        done.append((*last, h.hexdigest()))
                    last, h = (d, c), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pack(done)
            done = []
        if h:
            yield pack([(*last, h.hexdigest())])

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["depth", "label", "ends_sha256"])

    return packed.mapInArrow(run, "depth long, label long, ends_sha256 string")


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes (NODE) of the trie of conversations: convs (conv, n turns), a written table, and their turns (conv, pos, key, chars)."""
    rows = materialize(rows)
    parts = strides(rows)
    found, written = refine(convs, parts)
    members = materialize(found)
    forget(parts, *written)
    # The last class that a conversation shares; what follows is its own chain.
    last = members.groupBy("conv").agg(F.max(F.struct("depth", "label")).alias("at")).select("conv", F.col("at.depth").alias("shared"), F.col("at.label").alias("above"))
    convs = materialize(convs.join(last, "conv"))
    named = members.where("conv = label")
    up = members.select("conv", (F.col("depth") + 1).alias("depth"), F.col("label").alias("parent"))
    shared = materialize(named.join(up, ["conv", "depth"], "left").select("conv", "depth", "parent", "n", "chars"))
    # Fold back: children by parent, then leaves and saved characters by all classes a naming conversation is in.
    tops = convs.where("n > shared").select(F.col("shared").alias("depth"), F.col("above").alias("label"))
    below = shared.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("parent").alias("label"))
    children = materialize(below.unionByName(tops).groupBy("depth", "label").agg(F.count("*").alias("n_children")))
    childless = shared.join(children.select("depth", F.col("label").alias("conv")), ["depth", "conv"], "left_anti").select("conv")
    leaves = childless.unionByName(convs.where("n > shared").select("conv")).select("conv", F.lit(1).alias("leaf"))
    weight = F.when(F.col("conv") == F.col("label"), (F.col("n") - 1) * F.col("chars")).otherwise(0)
    deeper = Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    saved = members.withColumn("saved", F.sum(weight).over(deeper)).select("conv", "depth", "label", "saved")
    sums = saved.join(leaves, "conv", "left").groupBy("depth", "label").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    stop = ends(convs.where("n = shared").select(F.col("shared").alias("depth"), F.col("above").alias("label"), "conv"))
    whole = shared.withColumnRenamed("conv", "label").join(sums, ["depth", "label"], "left").join(children, ["depth", "label"], "left").join(stop, ["depth", "label"], "left")
    no = F.sha2(F.lit(""), 256)
    whole = whole.select("label", "depth", "parent", "n", F.coalesce("n_children", F.lit(0)), F.coalesce("n_leaves", F.lit(0)), F.coalesce("saved_tokens", F.lit(0)), F.coalesce("ends_sha256", no))
    tail = rows.join(convs.where("n > shared"), "conv").where("pos > shared")
    parent = F.when(F.col("pos") == F.col("shared") + 1, F.col("above")).otherwise(F.col("conv"))
    one = F.lit(1).cast("long")
    tail = tail.select("conv", "pos", parent, one, (F.col("pos") < F.col("n")).cast("long"), one, F.lit(0).cast("long"), F.when(F.col("pos") == F.col("n"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(no))
    return whole.toDF(*NODE).unionByName(tail.toDF(*NODE))


def digest(convs: DataFrame) -> DataFrame:
    """The rows of query op12_trie: the trie of conversations rebuilt by a fixed rule."""
    return nodes(*rebuilt(materialize(turns(convs))))
