"""Providers asked in waves: what one wave learns of them, all tasks of the next know."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import providers as P

MADE = "provider string, translated string, calls int, reason string, down array<string>"


class _Noted:
    """A provider that notes when it is down."""

    def __init__(self, provider: P.Provider, down: set[str]) -> None:
        self.provider, self.down = provider, down
        self.name = _name(provider)

    def __call__(self, texts: list[str]) -> list[str]:
        try:
            return self.provider(texts)
        except P.ProviderError as e:
            if e.kind == "down":
                self.down.add(self.name)
            raise


def _name(provider: P.Provider) -> str:
    return getattr(provider, "name", type(provider).__name__)


def locked(spark: SparkSession, folder: str, wave: int) -> set[str]:
    """The providers that waves before ``wave`` found down: as many as there are providers at most."""
    if not wave:
        return set()
    held = spark.read.schema("down array<string>").parquet(*[f"{folder}/wave={n}" for n in range(wave)])
    return {r[0] for r in held.select(F.explode("down")).distinct().collect()}


def translate_in_waves(
    items: DataFrame, providers: Sequence[P.Provider], folder: str, waves: int = 8, text: str = "source", keep: Sequence[str] = ("doc_id", "pos", "item_id"), first: int = 1
) -> DataFrame:
    """items' ``keep`` columns with provider, translated, calls and reason, made wave by wave into ``folder``.

    A document's items go in one wave, chosen by hash; the first wave takes about ``first`` in a thousand documents, so that a
    provider that refuses is found out at little cost, and the others share the rest. Each wave is planned from the route
    state that the waves before left with their results: a provider that was down is not asked again, by any task, also
    when the run is started again on the same folder, where finished waves stand. Within its wave a provider that is down
    is asked once for each Arrow batch at most.
    """
    spark = items.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    h = F.pmod(F.xxhash64(keep[0]), F.lit(1000 * max(1, waves - 1)))
    number = F.when(h < first * max(1, waves - 1), 0).otherwise(1 + h % max(1, waves - 1)).cast("int") if waves > 1 else F.lit(0)
    kinds = dict(items.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), MADE])
    for wave in range(waves):
        done = f"{folder}/wave={wave}"
        if fs.exists(path(f"{done}/_SUCCESS")):
            continue
        shut = locked(spark, folder, wave)
        chain = [p for p in providers if _name(p) not in shut]

        def run(frames: Iterator[pd.DataFrame], chain: list = chain) -> Iterator[pd.DataFrame]:
            for df in frames:
                down: set[str] = set()
                got = P.run_chain([t or "" for t in df[text]], [_Noted(p, down) for p in chain])
                out = pd.concat([df[list(keep)].reset_index(drop=True), pd.DataFrame(got, columns=["provider", "translated", "calls", "reason"])], axis=1)
                out["down"] = [sorted(down) if i == 0 else [] for i in range(len(out))]
                yield out

        items.where(number == wave).select(*keep, text).mapInPandas(run, schema).write.mode("overwrite").parquet(done)
    return spark.read.schema(schema).parquet(*[f"{folder}/wave={n}" for n in range(waves)]).drop("down")
