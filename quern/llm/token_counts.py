"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A batch of changes inserts, deletes or revises documents; every change is one
or two signed contributions (a revision takes the old counts back and adds the
new ones).  A batch is summed where
its texts are tokenized and then by key, and its deltas become one small table.

What is committed is told by a log of numbered manifests: each names the tables
of deltas that count and the batches that they hold.  A commit writes its table,
reads the last manifest and publishes the next one by a rename that fails if
that number is taken; it then reads again what the other writer published.  A
batch that is run again, in part or as a whole, therefore counts once, whatever
step a run was lost at, and tables that no manifest names count for nothing.
``compact`` folds the tables into one and the names of their batches into
another, publishes both the same way, and only then removes what the last two
manifests no longer name, so a lost run leaves the totals as they were.

A null text has no tokens but counts as a document; null sources and languages
are keys of their own.  Signs come from ``op``: insert, delete, or revise (which
reads old_source, old_lang and old_text).  An empty batch commits no deltas.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.tokens import VOCABULARY, ids_of
from quern.session import ship

KEYS = ["source", "lang", "tokenizer"]
MEASURES = ["documents", "tokens", "bytes"]
_DDL = "source string, lang string, tokenizer string, documents long, tokens long, bytes long"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counter(version: str) -> Callable[[str], int]:
    """The token counter of a tokenizer version: ``words-1``, or a file of the public vocabularies."""
    if version == "words-1":
        return lambda text: sum(1 for _ in _WORD.finditer(text))
    return ids_of(version).count


def signed(changes: DataFrame) -> DataFrame:
    """(sign, source, lang, text) of a batch with op, source, lang, text and, for revisions, old_ columns."""
    kind = "sign int, source string, lang string, text string"
    now = F.struct(F.when(F.col("op") == "delete", -1).otherwise(1).alias("sign"), "source", "lang", "text")
    parts = F.array(now.cast(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>"))
    if "old_text" in changes.columns:
        old = F.struct(
            F.lit(-1).alias("sign"),
            F.col("old_source").alias("source"),
            F.col("old_lang").alias("lang"),
            F.col("old_text").alias("text"),
        )
        parts = F.when(F.col("op") == "revise", F.concat(parts, F.array(old))).otherwise(parts)
    return changes.where("op in ('insert', 'revise', 'delete')").select(F.explode(parts).alias("c")).select("c.*")


def deltas(contributions: DataFrame, versions: tuple[str, ...] = (VOCABULARY, "words-1")) -> DataFrame:
    """Sums by key of signed contributions; each batch of rows is summed before the shuffle."""
    ship(contributions.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {v: counter(v) for v in versions}
        for batch in batches:
            sums: dict[tuple, list[int]] = {}
            signs, sources, langs = (batch.column(i).to_pylist() for i in range(3))
            for i, text in enumerate(batch.column(3)):
                text = text.as_py() or ""
                size = len(text.encode())
                for v, f in count.items():
                    s = sums.setdefault((sources[i], langs[i], v), [0, 0, 0])
                    s[0] += signs[i]
                    s[1] += signs[i] * f(text)
                    s[2] += signs[i] * size
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[j] for k in sums], pa.string()) for j in range(3)] + [
                    pa.array([s[j] for s in sums.values()], pa.int64()) for j in range(3)
                ],
                names=KEYS + MEASURES,
            )

    typed = contributions.select(
        F.col("sign").cast("int"),
        F.col("source").cast("string"),
        F.col("lang").cast("string"),
        F.col("text").cast("string"),
    )
    return typed.mapInArrow(run, _DDL).groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])


class Rollup:
    """Committed deltas below a folder that all writers share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm

    def _fs(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _versions(self) -> list[int]:
        fs, at = self._fs(f"{self.folder}/log")
        found = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(x) for x in found if x.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """version, tables, batches, and held: the table of the names of batches that were folded."""
        if version is None:
            version = max(self._versions(), default=0)
        if not version:
            return {"version": 0, "tables": [], "batches": [], "held": None}
        fs, at = self._fs(f"{self.folder}/log/{version:012d}")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """Make this the manifest of its version; False if another writer took the number."""
        hadoop = self.jvm.org.apache.hadoop.fs
        fs, staged = self._fs(f"{self.folder}/staged/{uuid.uuid4().hex}")
        out = fs.create(staged)
        out.write(json.dumps(manifest).encode())
        out.close()
        target = hadoop.Path(f"{self.folder}/log/{manifest['version']:012d}")
        fs.mkdirs(target.getParent())
        files = hadoop.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        how[0] = getattr(hadoop, "Options$Rename").NONE  # never over what is there
        try:
            files.rename(fs.makeQualified(staged), fs.makeQualified(target), how)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.toString():
                raise
            fs.delete(staged, True)
            return False
        return True

    def _holds(self, manifest: dict, batch: str) -> bool:
        if batch in manifest["batches"]:
            return True
        held = manifest["held"]
        return bool(held) and not self._read([held], "name string").where(F.col("name") == batch).isEmpty()

    def _read(self, tables: list[str], kind: str) -> DataFrame:
        if not tables:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.folder}/data/{t}" for t in tables])

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{name}")
        return name

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the deltas of a batch; False if a batch of that name is committed already."""
        if self._holds(self.manifest(), batch):
            return False
        table = self._write(changes)
        while True:
            last = self.manifest()
            if self._holds(last, batch):
                return False
            following = {"version": last["version"] + 1, "tables": [*last["tables"], table], "batches": [*last["batches"], batch]}
            if self._publish(last | following):
                return True

    def _sums(self, tables: list[str]) -> DataFrame:
        return self._read(tables, _DDL).groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])

    def totals(self) -> DataFrame:
        """Totals by key; keys whose documents have all gone are left out."""
        return self._sums(self.manifest()["tables"]).where(" or ".join(f"{m} <> 0" for m in MEASURES))

    def compact(self) -> bool:
        """Fold all committed deltas into one table; False if another writer was faster, and nothing changed."""
        last = self.manifest()
        base = self._write(self._sums(last["tables"]))
        names = self.spark.createDataFrame([(b,) for b in last["batches"]], "name string")
        if last["held"]:
            names = names.unionByName(self._read([last["held"]], "name string"))
        held = self._write(names)
        if not self._publish({"version": last["version"] + 1, "tables": [base], "batches": [], "held": held}):
            return False
        self.vacuum()
        return True

    def vacuum(self) -> None:
        """Remove older manifests, and the tables that they name and the last two do not."""
        *older, before, last = [0, 0, *self._versions()]
        named = [self.manifest(v) for v in (before, last)]
        used = {t for m in named for t in [*m["tables"], m["held"]]}
        for version in filter(None, older):
            manifest = self.manifest(version)
            for table in [*manifest["tables"], manifest["held"]]:
                if table and table not in used:
                    fs, at = self._fs(f"{self.folder}/data/{table}")
                    fs.delete(at, True)
            fs, at = self._fs(f"{self.folder}/log/{version:012d}")
            fs.delete(at, True)
