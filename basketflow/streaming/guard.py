"""A second start must ask for what the checkpoint holds.

Spark resumes from a checkpoint whatever the new query looks like, as far as the types of its
state agree: with another window width old and new windows mix in one table, and another number
of shuffle partitions is passed over in silence. Both are refused here, before anything runs.
"""

import json

from pyspark.sql import DataFrame, SparkSession

from basketflow import folders


class ChangedQuery(ValueError):
    """The checkpoint was made by a query that computes something else."""


def describe(operator: str, arguments: dict, result: DataFrame) -> dict:
    """What must not change between starts: operator, settings and the columns it gives."""
    return {
        "operator": operator,
        "arguments": {name: str(value) for name, value in sorted(arguments.items())},
        "columns": result.schema.simpleString(),
    }


def state_partitions(spark: SparkSession, checkpoint: str) -> dict[str, int]:
    """Number of state partitions of each stateful operator that a checkpoint holds."""
    if not folders.names(spark, f"{checkpoint}/state"):
        return {}
    found = spark.read.format("state-metadata").load(checkpoint)
    return {
        f"{row.operatorName} {row.operatorId}": row.numPartitions
        for row in found.select("operatorName", "operatorId", "numPartitions").distinct().collect()
    }


def refuse_changes(spark: SparkSession, checkpoint: str, plan: dict) -> None:
    """Raise :class:`ChangedQuery` if a checkpoint with progress belongs to another plan.

    The plan is noted beside the checkpoint at the first start. A checkpoint that was made before
    plans were noted is taken as it is, as far as its state partitions agree.
    """
    note = f"{checkpoint}.plan"
    if folders.names(spark, f"{checkpoint}/offsets"):
        stored = json.loads(folders.read_text(spark, note) or "{}")
        for name, was in stored.items():
            if plan.get(name) != was:
                raise ChangedQuery(
                    f"checkpoint {checkpoint} was made with {name} {was}, not {plan.get(name)};"
                    " start with the old settings, or with another checkpoint and table"
                )
        wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
        for operator, number in state_partitions(spark, checkpoint).items():
            if number != wanted:
                raise ChangedQuery(
                    f"checkpoint {checkpoint} keeps the state of {operator} in {number} partitions, but"
                    f" spark.sql.shuffle.partitions is {wanted}; it would be passed over. Set it to"
                    f" {number}, or start with another checkpoint and table"
                )
    folders.replace_text(spark, note, json.dumps(plan, sort_keys=True))
