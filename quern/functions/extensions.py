"""Where users put code of their own: row mappers as a table function, and a judge that a worker loads once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quern.operators.joins import two_stage
from quern.session import ship


@dataclass
class Mapper:
    """What a row becomes: any number of rows of a schema that may follow from the input's."""

    rows: Callable[[Row], Iterable[tuple]]
    schema: Callable[[T.StructType], T.StructType]


def register_mappers(spark: SparkSession, mappers: dict[str, Mapper], name: str = "map_rows") -> None:
    """Make ``name(TABLE(rows), 'mapper')`` a table function of SQL whose columns are the mapper's."""

    class MapRows:
        @staticmethod
        def analyze(rows: AnalyzeArgument, mapper: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or mapper.value not in mappers:
                raise ValueError(f"{name} takes a table and one of {', '.join(sorted(mappers))}")
            return AnalyzeResult(schema=mappers[mapper.value].schema(rows.dataType))

        def eval(self, row: Row, mapper: str):
            yield from mappers[mapper].rows(row)

    spark.udtf.register(name, udtf(MapRows))


def mapped(rows: DataFrame, mapper: str, name: str = "map_rows") -> DataFrame:
    """``rows`` through a registered mapper."""
    spark, view = rows.sparkSession, f"rows_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    try:
        return spark.sql(f"SELECT * FROM {name}(TABLE({view}), '{mapper}')")
    finally:
        spark.catalog.dropTempView(view)


Judge = Callable[[pd.DataFrame], pd.Series]
_LOADED: dict[str, Judge] = {}


def _loaded(model: str, load: Callable[[], Judge]) -> Judge:
    """The judge of this worker, which lives as long as the worker does."""
    if model not in _LOADED:
        _LOADED[model] = load()
    return _LOADED[model]


#: Bytes of an Arrow batch that are shown to a judge at once.
SHOWN = 4 << 20


def _frames(batch: pa.RecordBatch, zone: str) -> Iterator[tuple[pa.RecordBatch, pd.DataFrame]]:
    """Slices of a batch, each with its frame; times are those of the session's zone, without one."""
    step = max(1, batch.num_rows * SHOWN // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        frame = part.to_pandas(date_as_object=True, coerce_temporal_nanoseconds=True, maps_as_pydicts="lossy")
        for name, kind in zip(part.schema.names, part.schema.types, strict=True):
            if pa.types.is_timestamp(kind) and kind.tz:
                frame[name] = frame[name].dt.tz_convert(zone).dt.tz_localize(None)
        yield part, frame


def judged(rows: DataFrame, model: str, load: Callable[[], Judge], keep: list[str] | None = None) -> DataFrame:
    """``rows`` (or their columns ``keep``) with ``ok``, what the judge says of each; ``load`` runs once in each worker for a ``model``.

    A judge sees a few megabytes at once, however long the texts of a batch are.
    """
    ship(rows.sparkSession)
    keep = rows.columns if keep is None else keep
    zone = rows.sparkSession.conf.get("spark.sql.session.timeZone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _loaded(model, load)
        for batch in batches:
            for part, frame in _frames(batch, zone):
                ok = pa.array(judge(frame).astype(bool).to_numpy(), pa.bool_())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ok], names=[*keep, "ok"])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), T.StructField("ok", T.BooleanType())]))


def verified(rule: DataFrame, rows: DataFrame, keys: list[str], model: str, load: Callable[[], Judge]) -> DataFrame:
    """Rule verdicts (keys and ok); ``rows`` that fail are shown to the judge, and only those."""
    failed = rows.join(rule.where("not ok").select(*keys), keys, "left_semi")
    return two_stage(rule, judged(failed, model, load, keys), keys)
