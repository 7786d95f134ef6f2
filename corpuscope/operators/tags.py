"""Tags on files and directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope import session
from corpuscope.functions import paths
from corpuscope.functions import text as tx
from corpuscope.operators.ranking import number_rows


def new_tag_ids(names: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(name, created_order) -> + ``tag_id``: the slug of the name, and ``-1``, ``-2`` for
    later tags with the same slug, in creation order.

    The plain slug of every new name and every existing id is reserved; numbering passes over
    reserved ids, so ids are unique also across slugs. One slug may hold most of the names."""
    slugged = names.withColumn("_slug", tx.untrimmed_slug(F.col("name")))
    placed = number_rows(slugged, "_slug", "created_order").withColumn("_n", F.col("position") - 1)
    taken = slugged.select(F.col("_slug").alias("id"))
    if existing is not None:
        known = existing.select(F.col("tag_id").alias("id")).distinct()
        taken = taken.unionByName(known)
        held = known.select(F.col("id").alias("_slug"), F.lit(1).alias("_held"))
        placed = placed.join(held, "_slug", "left").withColumn("_n", F.col("_n") + F.coalesce("_held", F.lit(0)))
    # Ids that read slug-number and belong to someone else, with the count of free numbers
    # before each. No count of tags has more than 18 digits.
    parts = r"^([\s\S]*)-([1-9][0-9]{0,17})$"
    reserved = taken.distinct().select(
        F.regexp_extract("id", parts, 1).alias("_slug"),
        F.regexp_extract("id", parts, 2).try_cast("long").alias("k")
    ).filter(F.col("k").isNotNull()).join(slugged.select("_slug").distinct(), "_slug", "left_semi")
    reserved = session.written(reserved, "reserved")
    first = placed.filter("_n = 0").select("name", "created_order", F.col("_slug").alias("tag_id"))
    if reserved.isEmpty():
        return first.unionByName(placed.filter("_n > 0").select("name", "created_order", _numbered(F.col("_n"))))
    free_before = F.col("k") - (F.col("position") - 1)
    marks = number_rows(reserved, "_slug", "k").select(
        "_slug", (2 * free_before).alias("_at"), F.lit(None).cast("string").alias("name"),
        F.lit(None).alias("created_order"))
    # The n-th free number is the place of n among the numbers n and these marks.
    later = placed.filter("_n > 0").select("_slug", (2 * F.col("_n") + 1).alias("_at"), "name", "created_order")
    numbered = number_rows(later.unionByName(marks), "_slug", "_at").filter("name is not null")
    return first.unionByName(numbered.select("name", "created_order", _numbered(F.col("position"))))


def _numbered(number: Column) -> Column:
    return F.concat("_slug", F.lit("-"), number.cast("string")).alias("tag_id")


def apply_tags(tags: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (tag_id, applied_to, kind, applied_at, applied_by) that name a known tag whose
    scope allows the kind (``file`` or ``directory``)."""
    known = tags.select("tag_id", "scope")
    return requests.join(known, "tag_id").filter(
        (F.col("scope") == "both") | (F.col("scope") == F.col("kind"))
    ).drop("scope", "kind")


def remove_tags(applied: DataFrame, removals: DataFrame) -> DataFrame:
    """Applied tags without the listed (tag_id, applied_to) pairs."""
    return applied.join(removals.select("tag_id", "applied_to"), ["tag_id", "applied_to"], "left_anti")


def effective_tags(
    targets: DataFrame, applied: DataFrame, enabled: bool = True, override: bool = False,
) -> DataFrame:
    """(relative_path, tag_id, applied_to, distance): direct tags at distance 0, then those of
    each ancestor directory, nearest first; the root never contributes. ``override`` drops
    inherited ids that the path holds directly.

    Inheritance is worked out once per directory, then handed to its files."""
    held = applied.select("tag_id", "applied_to")
    direct = targets.select("relative_path").join(
        held, F.col("relative_path") == F.col("applied_to")
    ).select("relative_path", "tag_id", "applied_to", F.lit(0).alias("distance"))
    if not enabled:
        return direct
    placed = targets.select("relative_path", paths.directory(F.col("relative_path")).alias("directory"))
    chain = F.concat(F.array("directory"), paths.ancestors(F.col("directory")))
    by_directory = (
        placed.select("directory").filter("directory <> '.'").distinct()
        .select("directory", F.posexplode(chain).alias("up", "holder"))
        .join(held, F.col("holder") == F.col("applied_to"))
        .select("directory", "tag_id", "applied_to", (F.col("up") + 1).alias("distance")))
    inherited = placed.join(by_directory, "directory").select(
        "relative_path", "tag_id", "applied_to", "distance")
    if override:
        own = direct.select("relative_path", "tag_id")
        inherited = inherited.join(own, ["relative_path", "tag_id"], "left_anti")
    return direct.unionByName(inherited)
