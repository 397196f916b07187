"""The stored vector table: points by id, of which an upsert or a patch rewrites only the buckets they fall into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grootboek.checkpoints import checkpointed
from grootboek.schema import PAYLOAD
from grootboek.sources.bucket_table import DIGITS, BucketTable, unique
from grootboek.sources.ledgers import CheckFailed


class VectorTable(BucketTable):
    """Points (``point_id``, ``payload`` and others), one row per id."""

    @classmethod
    def of(cls, points: DataFrame, path: str, digits: int = DIGITS) -> VectorTable:
        """A new table of ``points``."""
        return cls.create(unique(points, ["point_id"]), path, ["point_id"], digits)

    def patch(self, patches: DataFrame) -> int:
        """Changes payload fields of the named points; a NULL keeps the field, an unknown id changes nothing."""
        patches = checkpointed(patches)
        return self.change(patches, lambda stored: patch_payload(stored, patches), adds=False)


def patch_payload(points: DataFrame, patches: DataFrame) -> DataFrame:
    """``points`` with the payload fields that ``patches`` names by id; a NULL patch keeps the field."""
    fields = [c for c in patches.columns if c != "point_id"]
    refused = set(fields) - set(PAYLOAD)
    if refused:
        raise CheckFailed(f"payload fields not allowed: {', '.join(sorted(refused))}")
    renamed = unique(patches, ["point_id"]).select("point_id", *[F.col(c).alias(f"_{c}") for c in fields])
    joined = points.join(renamed, "point_id", "left")
    payload = F.col("payload")
    for field in fields:
        payload = payload.withField(field, F.coalesce(F.col(f"_{field}"), F.col(f"payload.{field}")))
    return joined.withColumn("payload", payload).select(*points.columns)
