"""Name indexes of hosts, guests and speakers, and look-ups in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def name_index(rows: DataFrame, names: str, owner: list[str]) -> DataFrame:
    """name_normalized, name_original, owner columns: blanks dropped, one row per normalised name and owner, spelt as first seen."""
    each = rows.select(*owner, F.posexplode(names).alias("pos", "name_original")).withColumn("name_normalized", X.normalized_name(F.col("name_original")))
    return each.where("name_normalized <> ''").groupBy("name_normalized", *owner).agg(F.min_by("name_original", F.struct("pos", "name_original")).alias("name_original"))


def lookup(index: DataFrame, name: str, exact: bool = False, role: str | None = None) -> DataFrame:
    """Rows of the index with this name; literal, after trimming and lower-casing."""
    q = name.strip().lower()
    found = index.where(F.col("name_normalized") == q) if exact else index.where(F.contains("name_normalized", F.lit(q)))
    return found if role in (None, "any") else found.where(F.col("role") == role)


def owners(index: DataFrame, owner: str) -> DataFrame:
    """Name to its distinct owners."""
    return index.groupBy("name_normalized").agg(F.count_distinct(owner).alias("n_owners"))


def restore_names(turns: DataFrame, names: DataFrame) -> DataFrame:
    """speaker_name and role of the first of a turn's labels that has a name in (episode_id, label, name, label_role); else the sentinels."""
    each = turns.select("episode_id", "turn_count", F.posexplode("speaker").alias("pos", "label"))
    found = each.join(names, ["episode_id", "label"]).groupBy("episode_id", "turn_count").agg(F.min_by(F.struct("name", "label_role"), "pos").alias("f"))
    out = turns.drop("speaker_name", "role").join(found, ["episode_id", "turn_count"], "left")
    return out.withColumn("speaker_name", F.coalesce("f.name", F.lit(X.NO_SPEAKER))).withColumn("role", F.coalesce("f.label_role", F.lit(X.NO_ROLE))).drop("f")
