"""Queries on files that arrive: the log's statistics, the stop rule with state, appends that count once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.operators import token_stats
from quern.operators.sequence import bound
from quern.plans.facts import TOKENS, r6, read, tokens
from quern.plans.registry import query
from quern.plans.statistics import stats_sql
from quern.sources import writers
from quern.sources.tables import new_folder
from quern.streaming import logs

_LOG = "seq_id long, token_id long, token string, route string, overlap double, reverse_kl double, forward_kl double, final_loss double, student_logp double, teacher_logp double"


@query("S1_log_rollup", stats_sql("token_id, token", "token_id, token").replace("FROM src", "FROM tok"))
def s1(spark, sf):
    """Statistics of a token log that arrives in three parts; the stream is started for each on one checkpoint."""
    log, target, checkpoint = (new_folder(spark, name) for name in ("log", "sums", "checkpoint"))
    t = tokens(spark, sf).select(*[c.split()[0] for c in _LOG.split(", ")], "event_id")
    sums = lambda batch: token_stats.group_sums(batch, "token_id", "token")
    for part in range(3):
        t.where(F.col("event_id") % 3 == part).drop("event_id").write.mode("append").json(log)
        logs.run_available(logs.tail(spark, log, _LOG), target, checkpoint, sums)
    return r6(logs.rolled_up(spark, target, "token_id", "token"))


#: Boxes of all kinds between the halves of a document, by its id.
_TAILS = ["\\boxed{\\frac{1}{N}} done", "\\boxed{ } then \\boxed{N}", "open \\boxed{x \\boxed{N} more", "} stray \\boxed{{N}", "\\boxed{\\boxed{ }N}", "\\boxed {N}", "\\boxed{ \t }", ""]
_PIECE = 24
_CASES = " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_TAILS))


def _pieces(spark, sf, part, parts):
    """One of so many parts of each text's pieces: seq_id, pos, piece."""
    d = read(spark, sf, "documents")
    half = F.floor(F.length("text") / 2).cast("int")
    tail = F.replace(F.get(F.array(*[F.lit(t) for t in _TAILS]), (F.col("doc_id") % len(_TAILS)).cast("int")), F.lit("N"), F.col("n_chars").cast("string"))
    text = F.concat(F.left("text", half), tail, F.substr(F.col("text"), half + 1))

    def cut(t: Column) -> Column:
        n = F.ceil(F.length(t) / _PIECE)
        first, past = (F.ceil(n * k / parts).cast("int") for k in (part, part + 1))
        own = F.substr(t, first * _PIECE + 1, (past - first) * _PIECE)  # cut in one pass; a substring by place would count from the text's start
        return F.transform(F.regexp_extract_all(own, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), lambda x, i: F.struct((first + i).cast("long").alias("pos"), x.alias("piece")))

    return d.select(F.col("doc_id").alias("seq_id"), F.explode(bound(text, cut)).alias("x")).select("seq_id", "x.*")


@query("S2_boxed_stops", rf"""WITH x AS (SELECT doc_id, left(text, length(text) // 2) || replace(CASE doc_id % {len(_TAILS)} {_CASES} END, 'N', n_chars::VARCHAR) || substr(text, length(text) // 2 + 1) AS t FROM documents),
c AS (SELECT doc_id, unnest(string_split(t, '')) AS ch, unnest(range(1, length(t) + 1)) AS i FROM x WHERE contains(t, '\boxed{{')),
b AS (SELECT doc_id, i, ch, sum(CASE ch WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY i) AS depth FROM c WHERE ch IN ('{{', '}}')),
o AS (SELECT doc_id, i, depth - 1 AS outside FROM b JOIN x USING (doc_id) WHERE ch = '{{' AND i > 6 AND substr(t, (i - 6)::BIGINT, 7) = '\boxed{{'),
p AS (SELECT o.doc_id, o.i, min(b.i) AS e FROM o JOIN b ON b.doc_id = o.doc_id AND b.i > o.i AND b.depth = o.outside GROUP BY ALL),
s AS (SELECT doc_id, min(e) AS e FROM p JOIN x USING (doc_id) WHERE regexp_matches(substr(t, p.i + 1, p.e - p.i - 1), '[^ \t\n\r\f\v]') GROUP BY doc_id)
SELECT doc_id AS seq_id, (length(t) + {_PIECE - 1}) // {_PIECE} AS tokens, ((e + {_PIECE - 1}) // {_PIECE})::BIGINT AS stop_at FROM x LEFT JOIN s USING (doc_id) WHERE length(t) > 0""")
def s2(spark, sf):
    """Rollouts arrive by thirds of their pieces; state lies in the state store's files between three starts of the stream."""
    log, target, checkpoint = (new_folder(spark, name) for name in ("pieces", "stops", "checkpoint"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, logs.ROCKS)
    try:
        for part in range(3):
            _pieces(spark, sf, part, 3).write.mode("append").parquet(log)
            stream = logs.boxed_stops(logs.tail(spark, log, "seq_id long, pos long, piece string", "parquet", 1_000_000))
            logs.run_available(stream, target, checkpoint, mode="update")
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.parquet(target).groupBy("seq_id").agg(F.max("tokens").alias("tokens"), F.min("stop_at").alias("stop_at"))


@query(
    "S3_append_once",
    "SELECT event_id % 4 AS rank, event_id % 2 AS batch, event_type AS kind, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY ALL",
)
def s3(spark, sf):
    """Two batches by rank, each sent twice."""
    e, path = read(spark, sf, "events"), new_folder(spark, "once")
    e = e.select("event_id", F.col("event_type").alias("kind"), (F.col("event_id") % 4).alias("rank"))
    for part in (0, 1, 1, 0):
        writers.append_once(e.where(F.col("event_id") % 2 == part), path, str(part), "rank")
    back = spark.read.schema("event_id long, kind string, rank long, batch long").json(path)
    return back.groupBy("rank", "batch", "kind").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))
