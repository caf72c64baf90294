"""Batched enrichment of method rows with a generated description.

The prompt is a native ``concat``; the model call is a pandas UDF on the prompt alone: each
Arrow batch is cut into requests of ``batch`` prompts, answered by a pool of
``concurrency`` threads per task (cluster concurrency = tasks × pool). No other column goes
through Python, and there is no write-back or join but to a store of answers.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..plugins import DefaultEnricher
from ..sources import answers


def enrich_prompt(class_name, name, source):
    """L1: ``Class: {class_name}\\nMethod: {name}\\nSource Code:\\n{source_code}``."""
    return F.concat(F.lit("Class: "), class_name, F.lit("\nMethod: "), name, F.lit("\nSource Code:\n"), source)


def enrich(
    df: DataFrame,
    *,
    class_col: str = "class_name",
    name_col: str = "name",
    source_col: str = "source_code",
    enricher=None,
    out_col: str = "llm_comments",
    batch: int = K.ENRICH_BATCH,
    concurrency: int = K.ENRICH_CONCURRENCY,
    store: str | None = None,
    model: str = "enricher",
) -> DataFrame:
    """Add ``out_col`` to every row; prompts go to the enricher 32 at a time.

    With ``store``, a folder of answers (``sources.answers``), each distinct prompt of a
    ``model`` is sent once, by this job or an earlier one, and a job that died goes on.
    """
    enricher = enricher or DefaultEnricher()
    prompt = enrich_prompt(F.col(class_col), F.col(name_col), F.col(source_col))
    if store is not None:

        def call(prompts: list) -> list:
            return enricher.describe(pd.Series(prompts, dtype=object)).tolist()

        return answers.ask(df, store, call, model=model, prompt=F.coalesce(prompt, F.lit("")), out_col=out_col, batch=batch, concurrency=concurrency)

    @F.pandas_udf(T.StringType())
    def describe(prompts: pd.Series) -> pd.Series:
        chunks = [prompts.iloc[i : i + batch] for i in range(0, len(prompts), batch)]
        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            outs = list(pool.map(enricher.describe, chunks))
        return pd.concat(outs, ignore_index=True) if outs else pd.Series([], dtype=object)

    return df.withColumn(out_col, describe.asNondeterministic()(prompt))
