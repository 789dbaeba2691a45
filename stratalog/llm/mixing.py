"""Mixing sources to target weights by weighted fair queueing.

Within a source the documents are shuffled by a digest of their id. A document's virtual
finish time is the source's cumulative size up to and with it, divided by the source's
weight; a repeat of the source goes on counting. All copies of all documents are then
range-sorted by virtual finish. Running sums over this order tell how many words the open
sources have given at each moment; the order is cut where they reach the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import BROADCAST_IDS, Scratch, col

WORD = r"[^\x20\x09-\x0D]+"
#: A source is read at most so many times.
EPOCHS = 3
#: Weights of the sources by code point, over and over.
WEIGHTS = 3
#: Hex digits of the shuffle digest that name a run; a source's running sum goes over runs, then inside each.
RUN_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shuffled(doc_id: Column) -> Column:
    """The digest by which a source's documents are put in order."""
    return F.sha2(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), 256)


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], scratch: Scratch, name: str) -> DataFrame:
    """`rows` with running sums over a global order, the row itself included.

    The rows are range-sorted into as many ranges as there are shuffle partitions; a range
    adds the totals of those before it (a row each), so no task sees more than one range.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    ranged = scratch.save(ranged, name)
    totals = ranged.groupBy("__range").agg(*(F.sum(c).alias(f"__{k}") for k, c in sums.items()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    totals = totals.select("__range", *(F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select("*", *(F.sum(c).over(inside).alias(k) for k, c in sums.items())).join(F.broadcast(totals), "__range")
    return summed.select(*(col(c) for c in rows.columns), *((F.col(k) + F.col(f"__{k}")).alias(k) for k in sums))


def placed(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """uid, doc_id, source, size, source_size, weight, start of each input row; `start` is the source's cumulative size before it."""
    sized = docs.select(col(id_col).cast("long").alias("doc_id"), col(source_col).cast("string").alias("source"), word_count(col(text_col)).alias("size"))
    sized = scratch.save(sized.select("*", shuffled(F.col("doc_id")).alias("shuffle"), F.monotonically_increasing_id().alias("uid")), "sized")
    sized = sized.withColumn("run", F.substring("shuffle", 1, RUN_DIGITS))
    runs = scratch.save(sized.groupBy("source", "run").agg(F.sum("size").alias("run_size")), "runs")
    sources = runs.groupBy("source").agg(F.sum("run_size").alias("source_size"))
    sources = running(sources, [F.col("source").isNull(), F.col("source")], {"place": F.lit(1)}, scratch, "sources")
    sources = sources.select(F.col("source").alias("of"), "source_size", ((F.col("place") - 1) % WEIGHTS + 1).cast("long").alias("weight"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("run_start", F.coalesce(F.sum("run_size").over(before), F.lit(0)))
    runs = runs.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of").alias("r")
    inside = Window.partitionBy("source", "run").orderBy("shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    found = sized.withColumn("in_run", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d")
    found = found.join(runs, F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.run") == F.col("r.run")))
    return scratch.save(found.select("uid", "doc_id", "d.source", "size", "source_size", "weight", (F.col("run_start") + F.col("in_run")).alias("start")), "placed")


def sorted_copies(rows: DataFrame, scratch: Scratch, tie: str = "uid") -> DataFrame:
    """Every copy of every row (as `placed` has them) with words, range-sorted by virtual finish: its columns, epoch, from, virtual_finish, ended, ended_weight.

    `ended` is the number of words of the sources whose last copy has finished by then,
    `ended_weight` their weight: the words that all sources have given at the virtual time
    t are ended + t * (the weight of the others).
    """
    copies = rows.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1)))).withColumn("from", F.col("start") + F.col("epoch") * F.col("source_size"))
    copies = copies.withColumn("virtual_finish", (F.col("from") + F.col("size")) / F.col("weight"))
    last = F.col("from") + F.col("size") == F.col("source_size") * EPOCHS
    sums = {"ended": F.when(last, F.col("source_size") * EPOCHS).otherwise(0), "ended_weight": F.when(last, F.col("weight")).otherwise(0)}
    return running(copies, [F.col("virtual_finish"), F.col("source").isNull(), F.col("source"), F.col("epoch"), F.col(tie)], sums, scratch, "order")


def moment(ordered: DataFrame, rows: DataFrame) -> float:
    """The virtual time at which the order has given the total budget, the size of all sources; 0 without words. One row comes to the driver."""
    sources = rows.where("size > 0").groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("weight").alias("weight"))
    budget, weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    given = F.col("ended") + F.col("virtual_finish") * (F.lit(weights) - F.col("ended_weight"))
    # before this copy ends the source, it is among those that still give
    last = F.col("from") + F.col("size") == F.col("source_size") * EPOCHS
    ended = F.col("ended") - F.when(last, F.col("source_size") * EPOCHS).otherwise(0)
    open_weight = weights - F.col("ended_weight") + F.when(last, F.col("weight")).otherwise(0)
    at = F.struct("virtual_finish", ended.alias("ended"), open_weight.alias("open"))
    found = ordered.where(given >= budget).agg(F.min(at).alias("at")).first()["at"]
    return 0.0 if found is None else (budget - found["ended"]) / found["open"]


def words_before(cut: float) -> Column:
    """The words of a copy that lie before the virtual time `cut`."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.lit(cut) * F.col("weight")) - F.col("from")))


def mix_of(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, float]:
    """(placed rows, the order cut at the budget with `words` of each copy, the cut's virtual time)."""
    rows = placed(docs, scratch, id_col, text_col, source_col)
    ordered = sorted_copies(rows, scratch)
    cut = moment(ordered, rows)
    return rows, ordered.select("*", words_before(cut).alias("words")).where("words > 0"), cut


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, weight, target, start, virtual_finish (of the first copy), taken.

    Weights 1, 2, 3 repeat over the sources by code point, null last. The budget is the
    total of all sizes; a source ends after EPOCHS readings, and the others share what it
    leaves by weight. `taken` counts the words of all copies before the cut; the document
    at the cut is taken up to it, so a source's words equal its target to the word. Null
    text has size 0, null source is a source of its own, and rows with equal ids keep their
    own places. No rows, no result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows, mix, cut = mix_of(docs, scratch, id_col, text_col, source_col)
    taken = mix.groupBy("uid").agg(F.sum("words").alias("taken"))
    target = F.least(F.lit(cut) * F.col("weight"), (F.col("source_size") * EPOCHS).cast("double"))
    found = rows.join(taken, "uid", "left").select("doc_id", "source", "size", "source_size", "weight", target.alias("target"), "start", ((F.col("start") + F.col("size")) / F.col("weight")).alias("virtual_finish"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    scratch.drop("sized", "runs", "sources")
    return found


def in_order(scheduled: DataFrame) -> DataFrame:
    """The mix itself, globally sorted: doc_id, source, epoch, virtual_finish, words, for every copy that the budget reaches."""
    ordered = sorted_copies(scheduled, Scratch(scheduled.sparkSession, "mix-order"), "doc_id")
    mix = ordered.select("doc_id", "source", "epoch", "virtual_finish", words_before(moment(ordered, scheduled)).alias("words")).where("words > 0")
    return mix.orderBy("virtual_finish", "doc_id", "epoch")


def cuts(copies: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per source: source, least, last, room, from (source, doc_id, size, copies) of every row with words.

    Each document with words gets `least` whole copies, and those up to `last`, a shuffle
    digest and a size, one more. `room` is null but where rows with one id and size lie on
    both sides of the cut; then so many of them get the copy more.
    """
    keyed = copies.select("source", "copies", F.struct(shuffled(F.col("doc_id")).alias("shuffle"), "size").alias("key"))
    # the starts of a source's documents are less than its size apart: their copies differ by one at most
    sides = keyed.groupBy("source", "copies").agg(F.min("key").alias("low"), F.max("key").alias("top"))
    per = sides.groupBy("source").agg(F.min("copies").alias("least"), F.max("copies").alias("most"), F.min_by("low", "copies").alias("low"), F.max_by("top", "copies").alias("top"))
    last = F.when(F.col("most") > F.col("least"), F.col("top"))
    per = scratch.save(per.select("source", "least", "most", last.alias("last"), F.coalesce(last == F.col("low"), F.lit(False)).alias("split")), "per")
    split = per.where("split").select(F.col("source").alias("of"), "most", "last")
    tied = keyed.join(split, F.col("source").eqNullSafe(F.col("of")) & (F.col("key") == F.col("last")) & (F.col("copies") == F.col("most")))
    room = tied.groupBy("of").agg(F.count("*").alias("room"))
    return scratch.save(per.join(room, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "least", "last", "room"), "cuts")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, a row for every repeat, whole and unchanged.

    A copy is taken if no less than half of its words lie before the cut, so a source's
    words come as near to its target as whole copies allow. Documents that the budget does
    not reach, and those without words, leave. Rows with a null id or with equal ids each
    have their own place. Columns keep their names and values, whatever they are called.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows, mix, _ = mix_of(docs, scratch, id_col, text_col, source_col)
    whole = mix.where("2 * words >= size").groupBy("uid").agg(F.count("*").alias("copies"))
    copies = scratch.save(rows.where("size > 0").join(whole, "uid", "left").select("source", "doc_id", "size", F.coalesce("copies", F.lit(0)).alias("copies")), "copies")
    per = cuts(copies, scratch)
    scratch.drop("sized", "runs", "sources", "placed", "order", "copies")
    ties = per.where("room is not null").limit(1).count() > 0
    if per.limit(BROADCAST_IDS // 4 + 1).count() <= BROADCAST_IDS // 4:
        per = F.broadcast(per)
    # the whole row travels as one struct, so that no column of it can clash with what is added
    read = docs.select(F.struct(*(col(c) for c in docs.columns)).alias("doc"), col(text_col).alias("text"), shuffled(col(id_col)).alias("shuffle"), col(source_col).cast("string").alias("of")).where(F.regexp_like("text", F.lit(WORD)))
    read = read.join(per, F.col("of").eqNullSafe(F.col("source")))
    at_last, size = F.col("shuffle") == F.col("last.shuffle"), word_count(F.col("text"))
    early = F.coalesce((F.col("shuffle") < F.col("last.shuffle")) | (at_last & (size <= F.col("last.size"))), F.lit(False))
    tied = F.coalesce(F.col("room").isNotNull() & at_last & (size == F.col("last.size")), F.lit(False))
    out = (read.where(~tied) if ties else read).withColumn("more", early)
    if ties:
        place = F.row_number().over(Window.partitionBy("of").orderBy(F.sha2("text", 256)))
        out = out.unionByName(read.where(tied).withColumn("more", place <= F.col("room")))
    repeats = F.array_repeat(F.lit(0), (F.col("least") + F.col("more").cast("int")).cast("int"))
    return out.select("doc", F.explode(repeats)).select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
