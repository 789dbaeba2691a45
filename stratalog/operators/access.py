"""Access decisions over owner, mode bits and access entries. Permissions are bits: 4 read, 2 write, 1 execute (or admin)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What volume permissions stand for in bits; each implies the ones before it.
VOLUME_BITS = {"read": 4, "write": 6, "admin": 7}
#: Default mode of a volume without a stored list.
WORLD_WRITABLE = 0o777


def union_bits(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))


def masked(bits: Column, entries: Column) -> Column:
    """`bits` cut by the first mask entry, if there is one."""
    mask = F.get(F.filter(entries, lambda e: e["kind"] == "mask"), F.lit(0))["bits"]
    return F.when(mask.isNotNull(), bits.bitwiseAND(mask)).otherwise(bits)


def effective_bits(uid: Column, gids: Column, owner: Column, group: Column, mode: Column, entries: Column) -> Column:
    """What a user may do: as owner, else by the first entry of its own, else by the union over its groups, else as anyone.

    Entries are an array of (kind, id, bits) of kinds user, group and mask; the mask cuts
    entries, and the owning group's bits where there are entries at all.
    """
    user = F.get(F.filter(entries, lambda e: (e["kind"] == "user") & (e["id"] == uid)), F.lit(0))["bits"]
    groups = F.filter(entries, lambda e: (e["kind"] == "group") & e["id"].isNotNull() & F.array_contains(gids, e["id"]))
    bits_of = lambda shift: F.shiftright(mode, shift).bitwiseAND(F.lit(7).cast("long"))
    in_group = F.array_contains(gids, group)
    owning = F.when(in_group, F.when(F.size(entries) > 0, masked(bits_of(3), entries)).otherwise(bits_of(3)))
    named = F.when(F.size(groups) > 0, masked(union_bits(F.transform(groups, lambda e: e["bits"])), entries))
    by_group = F.coalesce(owning, F.lit(0).cast("long")).bitwiseOR(F.coalesce(named, F.lit(0).cast("long")))
    return (
        F.when(uid == owner, bits_of(6))
        .when(user.isNotNull(), masked(user, entries))
        .when(in_group | (F.size(groups) > 0), by_group)
        .otherwise(bits_of(0))
    )


def decisions(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """Requests (object_id, uid, gid, want) with `allowed`: the system's own user always, else by the object's list; without a list the object is open to all."""
    lists = objects.select("object_id", F.col("uid").alias("owner"), F.col("gid").alias("owning_group"), "mode", "entries")
    joined = requests.join(lists, "object_id", "left")
    bits = effective_bits(F.col("uid"), F.array("gid"), F.col("owner"), F.col("owning_group"), F.col("mode"), F.col("entries"))
    bits = F.when(F.col("owner").isNull(), F.lit(WORLD_WRITABLE & 7).cast("long")).otherwise(bits)
    return joined.select("object_id", "uid", "gid", "want", ((F.col("uid") == 0) | (bits.bitwiseAND(F.col("want")) != 0)).alias("allowed"))


def volume_bits(names: Column) -> Column:
    """An array of volume permissions (read, write, admin) as bits, null if one of them is none of these."""
    table = F.create_map(*(F.lit(x) for kv in VOLUME_BITS.items() for x in kv))
    known = F.size(F.array_except(names, F.array(*map(F.lit, VOLUME_BITS)))) == 0
    return F.when(known, union_bits(F.transform(names, lambda n: F.element_at(table, n).cast("long"))))
