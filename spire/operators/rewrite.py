"""Query rewriting with a text generator.

prompts (F10 + W7) -> generator -> F11 extraction -> F12 check -> the
rejected rows go once more through a second (more exploratory) generator
-> rewrites ordered by numeric id (T1).

A generator is a model callable ``Iterator[pd.DataFrame(id, prompt)] ->
Iterator[pd.DataFrame(id, generated)]`` run with ``mapInPandas``: Spark
partitions the prompts, each task feeds Arrow batches to the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_rewrite, needs_retry
from .layout import stored

Generator = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def generate(prompts: DataFrame, generator: Generator, id_col: str = "row_id",
             prompt_col: str = "prompt") -> DataFrame:
    id_type = prompts.schema[id_col].dataType.simpleString()
    return prompts.select(id_col, prompt_col).mapInPandas(generator, f"{id_col} {id_type}, generated string")


def rewrite_queries(prompts: DataFrame, generator: Generator, retry_generator: Generator | None = None,
                    id_col: str = "row_id", prompt_col: str = "prompt") -> DataFrame:
    """``(id, rewrite, retried)``; a rewrite that is empty or shorter
    than three words is generated once more with ``retry_generator`` and
    the second extraction is kept whatever it is (as the reference does)."""
    first = generate(prompts, generator, id_col, prompt_col) \
        .withColumn("rewrite", extract_rewrite("generated")) \
        .withColumn("_retry", needs_retry(F.col("rewrite")))
    if retry_generator is not None:  # read twice, generated once
        first = stored(first.drop("generated"), "rewrites")
    ok = first.where(~F.col("_retry")).select(id_col, "rewrite", F.lit(False).alias("retried"))
    if retry_generator is None:
        return ok.unionByName(first.where(F.col("_retry")).select(id_col, "rewrite", F.lit(False).alias("retried")))
    again = prompts.join(first.where(F.col("_retry")).select(id_col), id_col, "left_semi")
    second = generate(again, retry_generator, id_col, prompt_col) \
        .select(id_col, extract_rewrite("generated").alias("rewrite"), F.lit(True).alias("retried"))
    return ok.unionByName(second)
