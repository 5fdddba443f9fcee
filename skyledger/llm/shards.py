"""Shards of linked documents by balanced label propagation, in DataFrame operations only.

Documents are linked when their texts are equal. All start on a shard given by a hash. In each round the linked ones vote:
a group's members want to be where most of its members are. How many want to go from where to where, by gain, is a table of
the size of the shards' square; from it follow quotas under which no shard outgrows its rows, and as many documents move
as those allow. Documents without links want nothing: they fill up what is left, to the row.

A group of more than a quarter of a shard is first cut into pieces, each with one seed shard, three to a shard.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.session import stored

SHARDS = 16
ROUNDS = 8
#: Pieces of a large group: so many make up a shard, and so many of one group go to a shard.
PIECES, TOGETHER = 4, 3
#: Rows that are put in order together.
BUCKET = 1 << 16
_FINE = 1 << 20
#: Share of its rows that a shard must have to spare to be voted for.
_SLACK = 0.01

Moves = dict[tuple[int, int, int], float]


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def quotas(wanted: dict[tuple[int, int, int], int], held: list[int], room: list[int]) -> Moves:
    """How many may go, of the ``wanted`` moves (from, to, gain class), so that no shard that fits outgrows its ``room``.

    All go at first. Where too many arrive, the least gains stay behind; their places are then missing elsewhere, so this
    repeats until all shards fit. Works on a table of the shards' square, never on documents.
    """
    go: Moves = {k: float(n) for k, n in wanted.items()}
    for _ in range(1000):
        change = [0.0] * len(held)
        for (a, b, _g), n in go.items():
            change[a] -= n
            change[b] += n
        crowded = False
        for s, there in enumerate(held):
            over = min(there + change[s] - room[s], sum(n for (_a, b, _g), n in go.items() if b == s))
            if over <= 1e-6:
                continue
            crowded = True
            for gain in sorted({g for (_a, b, g) in go if b == s}):
                part = [k for k in go if k[1] == s and k[2] == gain]
                total = sum(go[k] for k in part)
                cut = min(over, total)
                for k in part:
                    go[k] -= go[k] * cut / total if total else 0
                over -= cut
                if over <= 1e-6:
                    break
        if not crowded:
            break
    return go


def _positions(rows: DataFrame, by: list[str], total: int, name: str) -> DataFrame:
    """``rows`` with a gapless number from 0 among those of equal ``by``, in an order given by a hash.

    Rows are put in order within buckets of about ``BUCKET``; a bucket's first number comes from counts of buckets.
    """
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("_luck", "_row", F.lit(3)), F.lit(ceil(total / BUCKET) or 1)))
    counts = dealt.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_many"))
    before = F.sum("_many").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*by, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_luck", "_row"))
    return dealt.join(offsets, [*by, "_bucket"]).withColumn(name, (F.col("_before") + rank - 1).cast("long")).drop("_bucket", "_before")


def _seeds(groups: DataFrame, rows: int, shards: int) -> DataFrame:
    """Large groups: their pieces and the place of the first one. Fewer than shards times ``PIECES`` groups can be that large."""
    largest = max(rows // (shards * PIECES), 1)
    large = groups.where(F.col("n") > largest).orderBy(F.desc("n"), "group").collect()
    out, place = [], 0
    for row in large:
        pieces = -(-row["n"] // largest)
        out.append((row["group"], pieces, place))
        place += -(-pieces // TOGETHER) * TOGETHER
    return groups.sparkSession.createDataFrame(out, f"group {groups.schema['group'].dataType.simpleString()}, pieces long, place long")


def _text_key(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.concat(F.hex(F.xxhash64(text)), F.hex(F.crc32(text.cast("binary"))), F.lit("-"), F.octet_length(text).cast("string"))


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: any two shards' counts differ by one at most. Equal texts (null is empty) are linked and go to one
    shard where the quotas allow; a group larger than a shard is spread over few. ``size`` is the text's UTF-8 bytes plus 1
    (null: 1), ``text_crc32`` its unsigned CRC-32; ``slot`` numbers a shard's rows from 0; ``grown_shard`` is null. Rows that
    repeat count each. Fewer rows than shards leave some shards empty; an empty table gives an empty result. Other columns
    are ignored. Texts never leave the first pass.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    slim = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            _text_key(F.col("text")).alias("group"),
            F.xxhash64("doc_id", text).alias("_luck"),
        ).withColumn("_row", F.monotonically_increasing_id()),
        "sharding",
    )
    total = slim.count()
    room = capacities(total, shards)
    groups = stored(slim.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    seeds = _seeds(groups, total, shards)
    luck = F.xxhash64("_luck", "_row")
    joined = slim.join(groups, "group", "left").join(F.broadcast(seeds), "group", "left")
    piece = F.coalesce(F.pmod(luck, "pieces"), F.lit(0))
    start = F.coalesce(F.floor((F.col("place") + piece) / TOGETHER), F.xxhash64("_luck", "_row", F.lit(1)))
    marked = stored(joined.select(*slim.columns, F.col("n").isNotNull().alias("linked"), piece.alias("piece"), F.pmod(start, F.lit(shards)).cast("int").alias("shard")), "marked")
    linked, free = marked.where("linked").drop("linked"), marked.where("NOT linked").drop("linked")

    for number in range(rounds):
        linked, moved = _one_round(linked, room, number)
        if not moved:
            break

    spare, settled = _within_room(linked, room, total)
    pool = free.select(*spare.columns).unionByName(spare)
    kept = [min(n, r) for n, r in zip(_held(linked, shards), room)]
    bounds, start_slots = [0], []
    for have, most in zip(kept, room):
        start_slots.append(have - bounds[-1])
        bounds.append(bounds[-1] + most - have)
    placed = _positions(pool.drop("shard"), [], total, "_place")
    shard = reduce(lambda x, y: x + y, [(F.col("_place") >= b).cast("int") for b in bounds[1:]], F.lit(0))
    first = F.element_at(F.array(*[F.lit(s).cast("long") for s in start_slots]), F.col("shard") + 1)
    filled = placed.withColumn("shard", shard).withColumn("slot", F.col("_place") + first)
    out = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    return settled.select(*out).unionByName(filled.select(*out))


def _held(linked: DataFrame, shards: int) -> list[int]:
    held = dict(linked.groupBy("shard").agg(F.count(F.lit(1))).collect())
    return [held.get(s, 0) for s in range(shards)]


def _one_round(linked: DataFrame, room: list[int], number: int) -> tuple[DataFrame, int]:
    """One vote and its moves: the linked documents on their new shards, and about how many moved.

    A scattered group votes for the shard that holds most of it, among those that have rows to spare: a full one would
    refuse it again and again. If none of its shards has, it meets on one that does.
    """
    spark, shards = linked.sparkSession, len(room)
    held = _held(linked, shards)
    spare = [s for s in range(shards) if held[s] < room[s] * (1 - _SLACK)] or list(range(shards))
    free = F.array(*[F.lit(s) for s in spare])
    cells = linked.groupBy("group", "piece", "shard").agg(F.count(F.lit(1)).alias("n"))
    # of equal votes, the shard that comes first after one given by the group: all members agree
    turn = F.pmod(F.xxhash64("group", "piece") + F.col("shard"), F.lit(shards))
    vote = F.max(F.struct(F.array_contains(free, F.col("shard")).alias("free"), "n", turn.alias("turn"), F.col("shard").alias("wish"))).alias("vote")
    votes = cells.groupBy("group", "piece").agg(vote, F.collect_list(F.struct("shard", "n")).alias("cells")).where(F.size("cells") > 1)
    meet = F.element_at(free, (F.pmod(F.xxhash64("group", "piece"), F.lit(len(spare))) + 1).cast("int"))
    wishes = stored(
        votes.select("group", "piece", F.when(F.col("vote.free"), F.col("vote.wish")).otherwise(meet).alias("wish"), F.when(F.col("vote.free"), F.col("vote.n")).otherwise(0).alias("most"), F.inline("cells"))
        .where("shard <> wish")
        .select("group", "piece", "shard", "wish", "n", F.floor(F.log2(F.col("most") + 1)).cast("int").alias("gain")),
        "wishes",
    )
    wanted = {(r["shard"], r["wish"], r["gain"]): r["n"] for r in wishes.groupBy("shard", "wish", "gain").agg(F.sum("n").alias("n")).collect()}
    go = quotas(wanted, held, room)
    moved = int(sum(go.values()))
    if not moved:
        return linked, 0
    shares = spark.createDataFrame([(*k, min(1.0, n / wanted[k])) for k, n in go.items()], "shard int, wish int, gain int, share double")
    granted = wishes.join(F.broadcast(shares), ["shard", "wish", "gain"]).select("group", "piece", "shard", "wish", "share")
    lot = F.pmod(F.xxhash64("_luck", "_row", F.lit(number + 7)), F.lit(_FINE)) / _FINE
    after = linked.join(granted, ["group", "piece", "shard"], "left").withColumn("_new", F.when(lot < F.col("share"), F.col("wish")).otherwise(F.col("shard")))
    return stored(after.withColumn("shard", F.col("_new")).select(*linked.columns), "moved"), moved


def _within_room(linked: DataFrame, room: list[int], total: int) -> tuple[DataFrame, DataFrame]:
    """Linked documents beyond their shard's rows, to be placed anew, and the others with their slots."""
    ranked = stored(_positions(linked, ["shard"], max(1, total // len(room)), "slot"), "ranked")
    most = F.element_at(F.array(*[F.lit(r).cast("long") for r in room]), F.col("shard") + 1)
    return ranked.where(F.col("slot") >= most).drop("slot"), ranked.where(F.col("slot") < most)
