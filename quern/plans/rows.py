"""Queries on rows: mapping, joins, rollouts, evaluation, JSON samples, sources and sinks."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import jsons as Y
from quern.functions import rows as C
from quern.functions.extensions import Mapper, mapped, register_mappers, verified
from quern.operators import evaluation, joins, rollouts, sequence
from quern.plans.facts import BOXED, IDS, TOKENS, boxed_texts, id_lists, r6, read, tokens
from quern.plans.registry import query
from quern.session import shared_folder, ship
from quern.sources import config, large_json, readers, writers
from quern.sources.writers import renamed


def _id() -> Column:
    return F.col("doc_id").cast("string")


@query(
    "C1_C2_first_of",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS nonblank, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '  ' END AS nonnull FROM documents",
)
def c1(spark, sf):
    even = F.col("doc_id") % 2 == 0
    first = F.when(even, F.col("lang")).otherwise(F.lit("  "))
    return read(spark, sf, "documents").select(
        "doc_id",
        C.first_nonblank(first, F.col("source")).alias("nonblank"),
        C.first_nonnull(F.lit(None).cast("string"), first).alias("nonnull"),
    )


@query(
    "C3_map_math",
    f"WITH {BOXED} SELECT gold AS problem, gold AS ground_truth, 'Solve ' || gold || '.' AS prompt, 'math' AS task_type, count(*) AS n FROM bx GROUP BY gold",
)
def c3(spark, sf):
    d = boxed_texts(spark, sf).select(
        F.col("gold").alias("question"),
        F.concat(F.lit("so \\boxed{"), "gold", F.lit("}")).alias("answer_text"),
        F.lit(" ").alias("problem"),
    )
    m = C.map_math(d, "Solve {problem}.", problem="problem", solution="answer_text", system="Be brief")
    return m.groupBy(
        "problem",
        "ground_truth",
        F.col("prompt_messages")[1]["content"].alias("prompt"),
        "task_type",
    ).agg(F.count("*").alias("n"))


def _chats(spark, sf):
    c = read(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m")).select(
        "conv_id",
        F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"),
    )


@query(
    "C4_map_code",
    "SELECT coalesce(first(text ORDER BY turn, text) FILTER (role = 'assistant'), '') AS target_text, '' AS ground_truth, 'code' AS task_type FROM conversations GROUP BY conv_id",
)
def c4(spark, sf):
    return C.map_code(_chats(spark, sf)).select("target_text", "ground_truth", "task_type")


@query("C5_map_generic", "SELECT doc_id::VARCHAR AS problem, source AS target_text, 'generic' AS task_type FROM documents")
def c5(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("prompt"), F.col("source").alias("target"))
    return C.adapted(d, "other").select("problem", "target_text", "task_type")


@query("C6_adapter", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'code' ELSE 'generic' END AS task_type FROM documents")
def c6(spark, sf):
    k = F.col("doc_id") % 3
    kind = F.when(k == 0, "dapo_math").when(k == 1, "function_calling").otherwise("x")
    task = F.when(kind.isin("math", "dapo_math"), "math").when(kind.isin("code", "function_calling"), "code").otherwise("generic")
    return read(spark, sf, "documents").select("doc_id", task.alias("task_type"))


@query(
    "C7_X25_messages",
    "SELECT conv_id, string_agg(trim(text, chr(32) || chr(10) || chr(9) || chr(13)), chr(10) || chr(10) ORDER BY turn, role, text) FILTER (trim(text, chr(32) || chr(10) || chr(9) || chr(13)) <> '') AS prompt FROM conversations GROUP BY conv_id",
)
def c7(spark, sf):
    return _chats(spark, sf).select("conv_id", Y.plain_prompt(F.col("messages")).alias("prompt"))


@query(
    "X26_chat_template",
    "SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn, role, text) || '<|assistant|>' || chr(10) AS prompt FROM conversations GROUP BY conv_id",
)
def x26(spark, sf):
    return _chats(spark, sf).select("conv_id", Y.chat_prompt(F.col("messages"), generation="<|assistant|>\n").alias("prompt"))


@query("C9_drop_columns", "SELECT doc_id, lang FROM documents")
def c9(spark, sf):
    return read(spark, sf, "documents").drop("text", "source", "n_chars")


@query(
    "C10_C11_filters",
    "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS DISTINCT FROM 1 AND n_chars > 100",
)
def c10(spark, sf):
    d = read(spark, sf, "documents").join(
        read(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("correct")),
        "doc_id",
        "left",
    )
    return d.where(~F.col("correct").eqNullSafe(F.lit(True)) & (F.col("n_chars") > 100)).select("doc_id")


def _vocabularies(spark, sf):
    p = read(spark, sf, "part").select("p_partkey")
    one = lambda step, n: p.where(F.col("p_partkey") % step == 0).select(F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("token"), (F.col("p_partkey") + n).cast("int").alias("id"))
    return one(2, 0), one(3, 1)


_VOC = "sv AS (SELECT 'w' || p_partkey AS token, p_partkey AS id FROM part WHERE p_partkey % 2 = 0), tv AS (SELECT 'w' || p_partkey AS token, p_partkey + 1 AS id FROM part WHERE p_partkey % 3 = 0)"


@query("J1_vocabulary_alignment", f"WITH {_VOC} SELECT token, sv.id AS student_id, tv.id AS teacher_id FROM sv JOIN tv USING (token)")
def j1(spark, sf):
    return joins.vocabulary_alignment(*_vocabularies(spark, sf))


@query(
    "J1_alignment_stats",
    f"WITH {_VOC}, j AS (SELECT count(*) AS n FROM sv JOIN tv USING (token)), c AS (SELECT (SELECT count(*) FROM sv) AS ns, (SELECT count(*) FROM tv) AS nt) SELECT n AS shared, ns - n AS student_only, nt - n AS teacher_only, round(n / greatest(ns, nt), 6) AS shared_ratio FROM j, c",
)
def j1b(spark, sf):
    return r6(joins.alignment_stats(*_vocabularies(spark, sf)))


@query(
    "J2_mapped_ids",
    f"WITH {TOKENS}, {IDS}, {_VOC}, e AS (SELECT seq_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM idl) SELECT e.seq_id, string_agg(coalesce(sv.id, -1)::VARCHAR, ',' ORDER BY i) AS mapped FROM e LEFT JOIN tv ON tv.id = e.id LEFT JOIN sv ON sv.token = tv.token GROUP BY e.seq_id",
)
def j2(spark, sf):
    m = joins.mapped_ids(id_lists(spark, sf), joins.vocabulary_alignment(*_vocabularies(spark, sf)), "ids", "seq_id")
    return m.select("seq_id", F.array_join(F.transform("mapped", lambda x: x.cast("string")), ",").alias("mapped"))


@query("J3_span_alignment", f"""WITH {TOKENS}, l AS (SELECT seq_id, pos, event_id % 5 AS a, event_id % 3 + 1 AS b FROM tok),
s AS (SELECT seq_id, pos, sum(a) OVER w - a AS lo, sum(a) OVER w AS hi FROM l WINDOW w AS (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
t AS (SELECT seq_id, pos, sum(b) OVER w - b AS lo, sum(b) OVER w AS hi FROM l WINDOW w AS (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT s.seq_id, s.pos AS s_pos, s.lo::BIGINT AS start_char, s.hi::BIGINT AS end_char, string_agg(t.pos::VARCHAR, ',' ORDER BY t.pos) AS t_pos FROM s JOIN t ON s.seq_id = t.seq_id AND least(s.hi, t.hi) - greatest(s.lo, t.lo) >= 1 WHERE s.hi > s.lo GROUP BY ALL""")
def j3(spark, sf):
    t = tokens(spark, sf)
    piece = lambda n: t.select("seq_id", "pos", F.repeat(F.lit("x"), n.cast("int")).alias("piece"))
    s, u = sequence.char_spans(piece(F.col("event_id") % 5)), sequence.char_spans(piece(F.col("event_id") % 3 + 1))
    return joins.span_alignment(s, u).withColumn("t_pos", F.array_join(F.transform("t_pos", lambda x: x.cast("string")), ","))


@query("J4_seeds", "SELECT item_id, unnest([11, 22, 33]) AS seed FROM benchmark")
def j4(spark, sf):
    return joins.expanded(read(spark, sf, "benchmark").select("item_id"), [11, 22, 33])


@query("G8_random_seeds", "SELECT 500 AS n, 500 AS distinct_n, true AS inside, true AS repeatable")
def g8(spark, sf):
    rows = spark.createDataFrame(
        [(x, x == y) for x, y in zip(joins.random_seeds(500, 7), joins.random_seeds(500, 7), strict=True)],
        "seed long, same boolean",
    )
    return rows.agg(
        F.count("*").alias("n"),
        F.count_distinct("seed").alias("distinct_n"),
        F.every((F.col("seed") >= 0) & (F.col("seed") < (1 << 31) - 1)).alias("inside"),
        F.every("same").alias("repeatable"),
    )


@query(
    "J5_R13_two_stage",
    "SELECT d.doc_id, coalesce(l.quality = 1, false) OR d.doc_id % 7 = 0 AS ok FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def j5(spark, sf):
    d = read(spark, sf, "documents").select("doc_id")
    rule = d.join(
        read(spark, sf, "labels").select("doc_id", "quality"),
        "doc_id",
        "left",
    ).select("doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("ok"))
    model = rule.where("not ok").select("doc_id", (F.col("doc_id") % 7 == 0).alias("ok"))
    return joins.two_stage(rule, model, ["doc_id"])


def _count_words(row):
    yield (*row, len(row.text.split(" ")), f"{row.lang}/{row.source}")


def _sentences(row):
    for place, part in enumerate(row.text.split(". ")):
        yield row.doc_id, place, len(part)


MAPPERS = {
    "words": Mapper(_count_words, lambda rows: T.StructType([*rows.fields, T.StructField("n", T.LongType()), T.StructField("kind", T.StringType())])),
    "sentences": Mapper(_sentences, lambda rows: T.StructType([rows["doc_id"], T.StructField("place", T.LongType()), T.StructField("length", T.LongType())])),
}


@query(
    "U1_mapper",
    """SELECT doc_id, -1 AS place, len(string_split(text, ' ')) AS n, lang || '/' || source AS kind FROM documents
    UNION ALL SELECT doc_id, unnest(range(len(string_split(text, '. ')))), unnest(list_transform(string_split(text, '. '), lambda x: length(x))), '' FROM documents""",
)
def u1(spark, sf):
    """Two mappers of one table function: one adds columns to its input's, one makes several rows of each."""
    ship(spark)
    register_mappers(spark, MAPPERS)
    d = read(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    words = mapped(d, "words").select("doc_id", F.lit(-1).cast("long").alias("place"), "n", "kind")
    return words.unionByName(mapped(d, "sentences").select("doc_id", "place", F.col("length").alias("n"), F.lit("").alias("kind")))


def _load_judge():
    """A judge that finds texts of many e good."""
    return lambda frame: frame["text"].str.count("e") * 10 > frame["text"].str.len()


@query(
    "U2_judge",
    """SELECT d.doc_id, coalesce(l.quality = 1, false) OR 10 * (length(text) - length(replace(text, 'e', ''))) > length(text) AS ok FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def u2(spark, sf):
    """What the labels do not call good is shown to a judge that each worker loads once."""
    d = read(spark, sf, "documents").select("doc_id", "text")
    good = F.coalesce(F.col("quality") == 1, F.lit(False)).alias("ok")
    rule = d.select("doc_id").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", good)
    return verified(rule, d, ["doc_id"], "many e", _load_judge)


@query(
    "J9_compatible",
    f"WITH {_VOC} SELECT false AS identical, (SELECT count(*) FROM sv ANTI JOIN (SELECT token, id - 1 AS id FROM tv) USING (token, id)) = 0 AS prefix_compatible",
)
def j9(spark, sf):
    s, t = _vocabularies(spark, sf)
    return joins.compatible(s, t.withColumn("id", (F.col("id") - 1).cast("int")))


@query("J10_zip", f"WITH {TOKENS}, {IDS} SELECT seq_id, list_sum(list_transform(ids, lambda x, i: x * i))::BIGINT AS dot FROM idl")
def j10(spark, sf):
    d = id_lists(spark, sf).withColumn("at", F.sequence(F.lit(1), F.size("ids")))
    z = joins.zipped(d, "ids", "at")
    return z.select("seq_id", F.aggregate("zipped", F.lit(0).cast("long"), lambda a, x: a + x["ids"] * x["at"]).alias("dot"))


_STOPS = {3: ["student_tokenizer"], 7: ["teacher_tokenizer"], 11: ["configured_extra"]}
_CUT = f"""{IDS}, r AS (SELECT seq_id, ids, ids[1:12] AS raw FROM idl), p AS (SELECT *, coalesce(least(nullif(coalesce(list_position(raw, 3), 0), 0), nullif(coalesce(list_position(raw, 7), 0), 0), nullif(coalesce(list_position(raw, 11), 0), 0)), 999) AS st, coalesce(nullif(coalesce(list_position(raw, 5), 0), 0), 999) AS pd FROM r),
c AS (SELECT *, CASE WHEN st < 999 AND st <= pd THEN st ELSE least(pd - 1, len(raw)) END AS n, CASE WHEN st < 999 AND st <= pd THEN raw[st] END AS stop_token_id FROM p),
cut AS (SELECT seq_id, raw, raw[1:n] AS token_ids, n, len(raw) AS raw_tensor_length, stop_token_id, stop_token_id IS NULL AND n >= 12 AS hit_horizon,
  CASE stop_token_id WHEN 3 THEN 'student_eos' WHEN 7 THEN 'teacher_eos' WHEN 11 THEN 'configured_eos' ELSE CASE WHEN n >= 12 THEN 'max_length' WHEN n < len(raw) THEN 'padding' ELSE 'sequence_end' END END AS stop_reason FROM c)"""


def _cut(spark, sf):
    return rollouts.truncated(id_lists(spark, sf), _STOPS, 5, 12)


@query(
    "R2_R3_truncate",
    f"WITH {TOKENS}, {_CUT} SELECT seq_id, n AS length, raw_tensor_length, stop_token_id, hit_horizon, stop_reason FROM cut",
)
def r3(spark, sf):
    return _cut(spark, sf).select(
        "seq_id",
        F.size("token_ids").alias("length"),
        "raw_tensor_length",
        "stop_token_id",
        "hit_horizon",
        "stop_reason",
    )


@query("J8_stop_set", f"WITH {TOKENS}, {IDS} SELECT seq_id, list_has_any(ids, [3, 7, 11]) AS any_stop FROM idl")
def j8(spark, sf):
    return id_lists(spark, sf).select("seq_id", F.arrays_overlap("ids", F.array(*[F.lit(i) for i in _STOPS])).alias("any_stop"))


@query(
    "R10_pad_first",
    f"WITH {TOKENS}, {IDS}, p AS (SELECT seq_id, ids[1:12] AS raw FROM idl), q AS (SELECT *, coalesce(nullif(list_position(raw, 5), 0), 999) AS pd FROM p) SELECT seq_id, CASE WHEN pd < 999 THEN pd - 1 ELSE len(raw) END AS length FROM q",
)
def r10(spark, sf):
    c = rollouts.truncate(F.col("ids"), [5], 5, 12, pad_first=True)
    return id_lists(spark, sf).withColumns(c).select("seq_id", F.size("token_ids").alias("length"))


def _final(spark, sf):
    d = _cut(spark, sf)
    text = F.when(F.col("seq_id") % 3 == 0, "\\boxed{1}\n").otherwise("x ")
    pieces = F.transform("token_ids", lambda t, i: F.when(i == 2, text).otherwise("y "))
    return rollouts.finalized(d.withColumn("pieces", pieces), eos_id=3, horizon=F.lit(12))


@query(
    "R6_finalize",
    f"WITH {TOKENS}, {_CUT}, f AS (SELECT *, seq_id % 3 = 0 AND stop_token_id IS NULL AND n > 3 AS boxed FROM cut) SELECT seq_id, CASE WHEN boxed THEN 4 ELSE n END AS length, CASE WHEN boxed THEN 'boxed_answer' ELSE stop_reason END AS stop_reason, boxed AS appended_eos, hit_horizon AND NOT boxed AS hit_horizon, CASE WHEN seq_id % 3 = 0 AND n >= 3 THEN 1 ELSE 0 END AS raw_boxed_count FROM f",
)
def r6_(spark, sf):
    return _final(spark, sf).select(
        "seq_id",
        F.size("token_ids").alias("length"),
        "stop_reason",
        "appended_eos",
        "hit_horizon",
        "raw_boxed_count",
    )


def _repeats(ids: str) -> str:
    grams = f"list_transform(generate_series(1, len({ids}) - 3), lambda i: array_to_string({ids}[i:i + 3], ' '))"
    return f"CASE WHEN len({ids}) >= 4 THEN 1 - len(list_distinct({grams})) / len({grams}) ELSE 0 END"


_REPORT = f"""WITH {TOKENS}, {_CUT}, f AS (SELECT *, seq_id % 3 = 0 AND stop_token_id IS NULL AND n > 3 AS boxed FROM cut),
g AS (SELECT *, CASE WHEN boxed THEN raw[1:3] || [3] ELSE token_ids END AS done, CASE WHEN boxed THEN 4 ELSE n END AS len, CASE WHEN boxed THEN 'boxed_answer' ELSE stop_reason END AS reason, hit_horizon AND NOT boxed AS hit, seq_id % 20 AS prompt FROM f)
SELECT 12 AS horizon, 16 AS requested_horizon, 40 AS total_length_limit, round(avg(len), 6) AS mean_generated_tokens, round(avg(raw_tensor_length), 6) AS raw_mean_generated_tokens, round(avg(greatest(raw_tensor_length - len, 0)), 6) AS mean_removed_tokens,
round(avg(prompt), 6) AS mean_prompt_tokens, round(avg(prompt + len), 6) AS mean_total_effective_tokens, 1.0::DOUBLE AS context_limited_fraction, median(len)::DOUBLE AS median_generated_tokens, max(len) AS max_generated_tokens, min(len) AS min_generated_tokens,
round(avg((stop_token_id IS NOT NULL)::INT), 6) AS eos_fraction, round(avg(hit::INT), 6) AS truncated_fraction, round(avg(hit_horizon::INT), 6) AS raw_truncated_fraction, round(avg((reason = 'boxed_answer')::INT), 6) AS boxed_answer_stop_fraction, round(avg(boxed::INT), 6) AS boxed_truncation_fraction, round(avg(boxed::INT), 6) AS appended_eos_fraction,
round(avg((reason = 'student_eos')::INT), 6) AS student_eos_fraction, round(avg((reason = 'teacher_eos')::INT), 6) AS teacher_eos_fraction, round(avg((reason = 'configured_eos')::INT), 6) AS configured_eos_fraction, round(avg((stop_token_id IS NULL)::INT), 6) AS no_eos_fraction, round(avg({_repeats("token_ids")}), 6) AS repeated_4gram_ratio, round(avg({_repeats("done")}), 6) AS effective_repeated_4gram_ratio, 0.0::DOUBLE AS multi_boxed_fraction, round(avg(CASE WHEN hit THEN 0.25 ELSE 1 END), 6) AS mean_sequence_loss_weight FROM g"""


@query("E13_E14_rollout_report", _REPORT)
def e14(spark, sf):
    d = _final(spark, sf).withColumns(
        {
            "horizon": F.lit(12),
            "requested_horizon": F.lit(16),
            "total_length_limit": F.lit(40),
            "prompt_tokens": F.col("seq_id") % 20,
            "seq_weight": rollouts.sequence_weight(F.col("hit_horizon"), 0.25),
        }
    )
    return r6(rollouts.report(d))


@query(
    "R7_R8_R9_limits",
    "SELECT conv_id, turn, least(16, least(40, 64) - (turn % 8)) AS horizon, CASE WHEN turn % 2 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS weight, 24 AS scheduled FROM conversations",
)
def r7(spark, sf):
    c = read(spark, sf, "conversations")
    return c.select(
        "conv_id",
        "turn",
        rollouts.effective_horizon(F.lit(16).cast("long"), F.lit(40), F.lit(64), F.col("turn") % 8).alias("horizon"),
        rollouts.sequence_weight(F.col("turn") % 2 == 0).alias("weight"),
        F.lit(rollouts.scheduled_horizon("esr", 100, 24)).alias("scheduled"),
    )


_CHUNKED = f"WITH {TOKENS}, {IDS}, k AS (SELECT seq_id, len(ids) AS n, (seq_id % 4)::INT AS chunk, (len(ids) - 1) // 8 AS last FROM idl)"


def _chunked(spark, sf):
    return id_lists(spark, sf).select(
        "seq_id",
        F.size("ids").alias("n"),
        (F.col("seq_id") % 4).cast("int").alias("chunk"),
        sequence.chunks(F.col("ids"), 8).alias("zero"),
        sequence.one_based_chunks(F.col("ids"), 8).alias("one"),
    )


@query(
    "R11_cut_length",
    f"{_CHUNKED} SELECT seq_id, CASE WHEN seq_id % 5 = 0 THEN least(n, 6) WHEN seq_id % 5 = 1 THEN n WHEN chunk <= last THEN chunk * 8 ELSE least(n, 6) END AS keep FROM k",
)
def r11(spark, sf):
    error = F.when(F.col("seq_id") % 5 == 0, F.lit(None)).otherwise(F.col("seq_id") % 5 != 1)
    return _chunked(spark, sf).select("seq_id", rollouts.cut_length(F.col("chunk"), error, F.col("zero"), F.col("n"), 6).alias("keep"))


@query(
    "R12_error_position",
    f"{_CHUNKED} SELECT seq_id, CASE WHEN chunk <= last THEN chunk * 8 + 1 END AS error_pos, coalesce(chunk <= last AND chunk * 8 + 1 <= 10, false) AS within FROM k",
)
def r12(spark, sf):
    at, within = rollouts.error_position(F.col("chunk"), F.col("one"), 10)
    return _chunked(spark, sf).select("seq_id", at.alias("error_pos"), within.alias("within"))


@query(
    "Y9_padding",
    f"WITH {TOKENS}, {IDS}, m AS (SELECT max(len(ids)) AS w FROM idl) SELECT seq_id, w AS width, list_sum(list_transform(ids, lambda x, i: x * (i + w - len(ids))))::BIGINT AS left_dot, list_sum(list_transform(ids, lambda x, i: x * i))::BIGINT - (w - len(ids)) * (w + len(ids) + 1) // 2 AS right_dot FROM idl, m",
)
def y9(spark, sf):
    d = id_lists(spark, sf)
    d = d.crossJoin(F.broadcast(d.agg(F.max(F.size("ids")).alias("w"))))  # one row
    dot = lambda a: F.aggregate(F.transform(a, lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return d.select(
        "seq_id",
        F.col("w").alias("width"),
        dot(C.padded(F.col("ids"), F.col("w"), 0, True)).alias("left_dot"),
        dot(C.padded(F.col("ids"), F.col("w"), -1, False)).alias("right_dot"),
    )


@query(
    "Y10_Y11_labels",
    f"WITH {TOKENS}, {IDS}, p AS (SELECT seq_id, ids, least(len(ids), 4) AS np, least(len(ids), greatest(10 - least(len(ids), 4), 0)) AS nt FROM idl) SELECT seq_id, np + nt AS length, np AS masked, list_sum(ids[-np:] || ids[1:nt])::BIGINT AS total FROM p",
)
def y10(spark, sf):
    ids, labels = C.assembled(F.col("ids"), F.col("ids"), 10, 4)
    total = F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x)
    return id_lists(spark, sf).select(
        "seq_id",
        F.size(ids).alias("length"),
        F.size(F.filter(labels, lambda x: x == -100)).alias("masked"),
        total.alias("total"),
    )


@query("Y12_id_lists", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 1 ELSE 2 END AS n FROM events")
def y12(spark, sf):
    k = F.col("event_id") % 3
    one = rollouts.normalised_ids(F.when(k == 1, F.col("event_id")), "scalar")
    many = rollouts.normalised_ids(F.array(F.lit(1), F.lit(None).cast("int"), F.lit(2)), "array")
    return read(spark, sf, "events").select("event_id", F.size(F.when(k == 2, many).otherwise(one)).alias("n"))


#: Answers of a judge: prose around an object, a fenced one, one of odd values, and none.
_VERDICTS = """CASE doc_id % 4 WHEN 0 THEN 'ok {"has_error": true, "explanation": "' || source || '", "earliest_error_chunk_id": "' || (doc_id % 7) || '"} end' WHEN 1 THEN '```json' || chr(10) || '{"has_error": ' || CASE WHEN n_chars % 2 = 0 THEN 'true, "earliest_error_chunk_id": ' || (n_chars % 9) ELSE 'false' END || '}' || chr(10) || '```'
WHEN 2 THEN '{"has_error": "' || lang || '", "earliest_error_chunk_id": "' || lang || '"}' ELSE 'nothing in ' || source END"""
_ESCAPED = "'<think>no {</think> it is ```json {x \\{\"a\": ' || doc_id || ', \"b\": \"' || source || ' ' || n_chars || '\"\\} rest'"


@query("Y1_repaired_json", f"SELECT doc_id, regexp_extract(replace(replace({_ESCAPED}, '\\{{', '{{'), '\\}}', '}}'), '\\{{[^{{}}]*\\}}') AS body FROM documents")
def y1(spark, sf):
    ship(spark)
    text = F.concat(
        F.lit('<think>no {</think> it is ```json {x \\{"a": '),
        _id(),
        F.lit(', "b": "'),
        "source",
        F.lit(" "),
        F.col("n_chars").cast("string"),
        F.lit('"\\} rest'),
    )
    return read(spark, sf, "documents").select("doc_id", Y.repaired(text).alias("body"))


def _decided(spark, sf):
    ship(spark)
    d = read(spark, sf, "documents").select("doc_id", F.expr(_VERDICTS.replace("chr(10)", "char(10)")).alias("t"))
    return d.select("doc_id", Y.decision(F.col("t")).alias("d")).select("doc_id", "d.*")


@query(
    "Y2_Y3_decisions",
    f"""WITH t AS (SELECT doc_id, {_VERDICTS} AS t FROM documents) SELECT doc_id, nullif(regexp_extract(t, '"has_error": (true|false)', 1), '')::BOOLEAN AS has_error,
    nullif(regexp_extract(t, '"earliest_error_chunk_id": "?([0-9]+)', 1), '')::INT AS chunk, NOT contains(t, '{{') AS parse_failed, CASE WHEN contains(t, '{{') THEN regexp_extract(t, '"explanation": "([^"]*)"', 1) ELSE 'Could not parse judge output: ' || t END AS said FROM t""",
)
def y2(spark, sf):
    return _decided(spark, sf).select(
        "doc_id", "has_error", F.col("earliest_error_chunk_id").alias("chunk"), "parse_failed", F.col("explanation").alias("said")
    )


def _judged(spark, sf):
    ship(spark)
    k = F.col("doc_id") % 4
    error = F.concat(F.lit('ok {"has_error": true, "earliest_error_chunk_id": "'), (F.col("doc_id") % 7).cast("string"), F.lit('"} end'))
    t = F.when(k == 0, error).when(k == 1, '```json\n{"has_error": false}\n```').when(k == 2, '{"has_error": "yes"}').otherwise("nothing here")
    return read(spark, sf, "documents").select("doc_id", Y.decision(t).alias("d")).select("doc_id", "d.*")


@query("E24_judge_summary", """WITH j AS (SELECT CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS c, doc_id % 11 <> 0 AS full_, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS e, CASE WHEN doc_id % 4 = 0 AND doc_id % 7 < 5 THEN doc_id % 7 * 16 + 1 END AS pos FROM documents),
k AS (SELECT *, coalesce(c, false) AS skip, NOT coalesce(c, false) AND full_ AS judged FROM j)
SELECT count(*) AS total_seen, count(*) FILTER (judged) AS judged, count(*) FILTER (skip) AS skipped_correct, count(*) FILTER (NOT skip AND NOT full_) AS missing_problem_or_generation, count(*) FILTER (judged AND e IS NULL) AS parse_failed,
count(*) FILTER (judged AND NOT coalesce(c, false)) AS wrong_or_unknown_judged, count(*) FILTER (judged AND NOT e AND NOT c) AS wrong_without_error, count(*) FILTER (judged AND NOT e) AS without_error, count(*) FILTER (judged AND e) AS with_error,
count(*) FILTER (judged AND e AND pos IS NOT NULL) AS error_located, count(*) FILTER (judged AND e AND pos IS NULL) AS error_unlocated, count(*) FILTER (judged AND e AND pos <= 40) AS error_within, count(*) FILTER (judged AND e AND pos > 40) AS error_beyond,
round(count(*) FILTER (judged AND e AND pos <= 40) / nullif(count(*) FILTER (judged AND e AND pos IS NOT NULL), 0), 6) AS within_of_located, round(count(*) FILTER (judged AND NOT e) / nullif(count(*) FILTER (judged), 0), 6) AS without_error_of_judged, round(count(*) FILTER (judged AND e IS NULL) / nullif(count(*) FILTER (judged), 0), 6) AS parse_failed_of_judged FROM k""")
def e24(spark, sf):
    chunks = sequence.one_based_chunks(F.sequence(F.lit(1), F.lit(80)), 16)
    k = F.col("doc_id") % 5
    pos, within = rollouts.error_position(F.col("earliest_error_chunk_id"), chunks, 40)
    cases = _judged(spark, sf).withColumns(
        {"correct": F.when(k == 0, True).when(k < 3, False), "complete": F.col("doc_id") % 11 != 0, "error_pos": pos, "within": within}
    )
    return r6(evaluation.judge_summary(cases))


_SAMPLES = "CASE doc_id % 5 WHEN 0 THEN '{\"resps\": [[\"gen ' || doc_id || '\"]], \"doc\": {\"problem\": \"p' || n_chars || '\", \"answer\": \"a' || n_chars % 13 || '\"}, \"exact_match\": ' || doc_id % 2 || '.0}' WHEN 1 THEN '{\"response\": \"gen ' || doc_id || '\", \"question\": \"p' || n_chars || '\", \"target\": \"a' || n_chars % 13 || '\", \"metrics\": {\"acc\": ' || CASE WHEN n_chars % 2 = 0 THEN 'true' ELSE 'false' END || '}}' WHEN 2 THEN '{\"filtered_resps\": [{\"text\": \"gen ' || doc_id || '\"}], \"arguments\": {\"query\": \"p' || n_chars || '\"}, \"gold\": \"a' || n_chars % 13 || '\", \"correct\": ' || n_chars % 2 || '}' WHEN 3 THEN '{\"arguments\": {\"output\": \"gen ' || doc_id || '\", \"input\": \"p' || n_chars || '\"}, \"solution\": {\"answer\": \"a' || n_chars % 13 || '\"}}' ELSE '{\"other\": 1}' END"


def _samples(spark, sf):
    text = F.expr(_SAMPLES.replace("\\", ""))
    return read(spark, sf, "documents").select("doc_id", text.alias("j")).withColumn("v", Y.variant(F.col("j")))


def _first_path(*paths: str) -> str:
    return "coalesce(" + ", ".join(f"j ->> '$.{p}'" for p in paths) + ", '')"


_RIGHT = "CASE WHEN json_exists(j, '$.exact_match') THEN (j ->> '$.exact_match')::DOUBLE > 0 WHEN json_exists(j, '$.correct') THEN (j ->> '$.correct')::INT > 0 WHEN json_exists(j, '$.metrics.acc') THEN (j ->> '$.metrics.acc')::BOOLEAN END"


@query(
    "Y4_Y5_Y6_Y7_samples",
    f"WITH s AS (SELECT doc_id, ({_SAMPLES})::JSON AS j FROM documents) SELECT doc_id, {_first_path('resps[0][0]', 'filtered_resps[0].text', 'response', 'arguments.output')} AS generation, "
    f"{_first_path('doc.problem', 'question', 'arguments.query', 'arguments.input')} AS problem, {_first_path('doc.answer', 'target', 'gold', 'solution.answer')} AS reference, {_RIGHT} AS correct FROM s",
)
def y4(spark, sf):
    v = F.col("v")
    return _samples(spark, sf).select(
        "doc_id",
        Y.generation(v).alias("generation"),
        Y.problem(v).alias("problem"),
        Y.reference(v).alias("reference"),
        Y.correctness(v).alias("correct"),
    )


@query("A7_H5_looks_like_sample", f"SELECT doc_id, list_has_any(json_keys({_SAMPLES}), {Y.SAMPLE_KEYS}) AS sample FROM documents")
def a7(spark, sf):
    return _samples(spark, sf).select("doc_id", Y.looks_like_sample(F.col("j")).alias("sample"))


#: A message, a list of messages and bare texts, a Python literal, and plain text.
_QUOTE = "' || chr(39) || '"
_MESSAGES = f"""CASE doc_id % 4 WHEN 0 THEN '{{"role": "user", "text": "' || source || '"}}' WHEN 1 THEN '[{{"content": "' || lang || '"}}, "b' || n_chars || '", " "]'
WHEN 2 THEN '[{{{_QUOTE}role{_QUOTE}: {_QUOTE}user{_QUOTE}, {_QUOTE}value{_QUOTE}: {_QUOTE}' || source || ' ' || n_chars || '{_QUOTE}}}]' ELSE ' ' || lang || ' ' || source || ' ' END"""


@query(
    "Y8_messages",
    f"""WITH m AS (SELECT doc_id, {_MESSAGES} AS t FROM documents), x AS (SELECT doc_id, t, replace(t, chr(39), '"') AS j FROM m)
    SELECT doc_id, CASE WHEN starts_with(j, '[') THEN len(list_filter(from_json(j, '["JSON"]'), lambda e: trim(e::VARCHAR, '" ') <> '')) ELSE 1 END::INT AS n,
    CASE WHEN starts_with(j, '[') THEN coalesce(j ->> '$[0].content', j ->> '$[0].value') WHEN starts_with(j, '{{') THEN j ->> '$.text' ELSE trim(t) END AS content FROM x""",
)
def y8(spark, sf):
    ship(spark)
    text = F.expr(_MESSAGES.replace("chr(39)", "char(39)"))
    rows = read(spark, sf, "documents").select("doc_id", text.alias("t"))
    return rows.select("doc_id", Y.messages(F.col("t")).alias("m")).select("doc_id", F.size("m").alias("n"), F.col("m")[0]["content"].alias("content"))


_GRADED = "gr AS (SELECT doc_id // 4 AS example_id, doc_id % 3 = 0 AS ok, doc_id % 6 NOT IN (0, 4, 5) AS bad FROM documents)"


@query(
    "E23_scores",
    f"WITH {_GRADED}, p AS (SELECT example_id, count(*) AS n, count(*) FILTER (ok) AS r, count(*) FILTER (bad) AS b FROM gr GROUP BY 1) SELECT round(avg(r / n), 6) AS avg_at_n, round(avg((r > 0)::INT), 6) AS pass_at_n, round(avg((r = 0)::INT), 6) AS solve_none, round(avg((r = n)::INT), 6) AS solve_all, sum(b)::BIGINT AS format_errors, sum(n)::BIGINT AS responses FROM p",
)
def e23(spark, sf):
    from quern.functions.answers import format_error

    g = boxed_texts(spark, sf).select(
        F.floor(F.col("doc_id") / 4).alias("example_id"),
        (F.col("doc_id") % 3 == 0).alias("ok"),
        format_error(F.col("text")).alias("format_error"),
    )
    return r6(evaluation.scores(g))


@query(
    "A11_D20_gaps",
    "WITH r AS (SELECT 2 * (doc_id // 4) AS k, text AS response FROM documents) SELECT g.id AS example_id, count(response) AS n, coalesce(string_agg(response, ',' ORDER BY response), '') AS responses FROM (SELECT unnest(range(0, (SELECT max(k) FROM r) + 1)) AS id) g LEFT JOIN r ON r.k = g.id GROUP BY 1",
)
def a11(spark, sf):
    d = read(spark, sf, "documents").select((2 * F.floor(F.col("doc_id") / 4)).alias("example_id"), F.col("text").alias("response"))
    return evaluation.with_gaps(d).select(
        "example_id",
        F.size("responses").cast("long").alias("n"),
        F.array_join("responses", ",").alias("responses"),
    )


@query(
    "A11_gap_intervals",
    """WITH r AS (SELECT DISTINCT doc_id * doc_id % 100003 * 1000000007 AS id FROM documents WHERE doc_id % 3 > 0), n AS (SELECT id, lag(id, 1, -1) OVER (ORDER BY id) AS near FROM r)
SELECT near + 1 AS "first", id - 1 AS "last" FROM n WHERE near + 1 < id""",
)
def a11_intervals(spark, sf):
    """Ids that lie far apart: intervals without rows, none of which is written out."""
    d = read(spark, sf, "documents").where("doc_id % 3 > 0")
    return evaluation.gaps(d.select(F.expr("doc_id * doc_id % 100003 * 1000000007").alias("example_id")))


@query(
    "E25_aligned_loss",
    f"WITH {TOKENS}, g AS (SELECT seq_id, pos // 3 AS gid, sum(student_logp) AS s, sum(teacher_logp) AS t, first(seq_weight) AS w FROM tok WHERE student_logp IS NOT NULL GROUP BY 1, 2), q AS (SELECT seq_id, avg(greatest(least(s - t, 0.5), -0.5)) AS m, first(w) AS w FROM g GROUP BY 1) SELECT round(sum(m * w) / greatest(sum(w), 1.0), 6) AS loss FROM q",
)
def e25(spark, sf):
    t = tokens(spark, sf).where("student_logp is not null").withColumn("group_id", F.floor(F.col("pos") / 3))
    return r6(evaluation.aligned_loss(t, 0.5))


@query("E26_H2_R1_eos_sources", f"""WITH {_VOC}, a AS (SELECT id AS token_id, token, 'student_tokenizer' AS source, true AS native FROM sv WHERE id IN (6, 12) UNION ALL SELECT sv.id, token, 'teacher_tokenizer', false FROM tv JOIN sv USING (token) WHERE tv.id IN (7, 19) UNION ALL SELECT id, token, 'configured_extra', false FROM sv WHERE token IN ('w6', 'w24'))
SELECT token_id, token, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, bool_or(native) AS native FROM a GROUP BY 1, 2""")
def e26(spark, sf):
    r = joins.resolved_eos(*_vocabularies(spark, sf), {"student_tokenizer": [6, 12]}, {"teacher_tokenizer": [7, 19]}, ["w6", "w24"])
    return r.withColumn("sources", F.array_join("sources", ","))


@query("H3_preferred_eos", f"""WITH {_VOC}, a AS (SELECT id AS token_id, 'student' AS side FROM sv WHERE id IN (6, 12) UNION ALL SELECT sv.id, 'teacher' FROM tv JOIN sv USING (token) WHERE tv.id IN (7, 19) UNION ALL SELECT id, 'extra' FROM sv WHERE token = 'w24'),
b AS (SELECT token_id, bool_or(side = 'teacher') AS t, bool_or(side = 'student') AS s FROM a GROUP BY 1) SELECT token_id FROM b ORDER BY CASE WHEN t AND NOT s THEN 0 WHEN t THEN 1 ELSE 2 END, token_id LIMIT 1""")
def h3(spark, sf):
    return joins.preferred_teacher_eos(
        joins.resolved_eos(*_vocabularies(spark, sf), {"student_tokenizer": [6, 12]}, {"teacher_tokenizer": [7, 19]}, ["w24"])
    )


@query("H6_concatenated", "SELECT 'events' AS t, event_id AS id FROM events UNION ALL SELECT 'docs', doc_id FROM documents")
def h6(spark, sf):
    e = read(spark, sf, "events").select(F.lit("events").alias("t"), F.col("event_id").alias("id"))
    return e.unionByName(read(spark, sf, "documents").select(F.lit("docs").alias("t"), F.col("doc_id").alias("id")))


@query("A1_A2_scan", "SELECT item_id, length(text) AS n FROM benchmark")
def a1(spark, sf):
    return readers.table(spark, f"{sf}/benchmark.parquet").select("item_id", F.length("text").alias("n"))


@query("A8_source_file", "SELECT 'benchmark.parquet' AS f, count(*) AS n FROM benchmark")
def a8(spark, sf):
    d = readers.with_source(read(spark, sf, "benchmark"))
    return d.groupBy(F.regexp_extract("source_file", r"([a-z]+\.parquet)", 1).alias("f")).agg(F.count("*").alias("n"))


@query("A9_event_filter", "SELECT event_id FROM events WHERE event_type = 'click'")
def a9(spark, sf):
    return read(spark, sf, "events").where(F.col("event_type") == "click").select("event_id")


@query("A10_benchmark_samples", "SELECT item_id AS example_id, text AS prompt, item_id::VARCHAR AS answer FROM benchmark")
def a10(spark, sf):
    b = read(spark, sf, "benchmark").select(
        "item_id",
        F.array(F.struct(F.col("text").alias("content"))).alias("prompt"),
        F.struct(F.col("item_id").alias("ground_truth")).alias("reward_model"),
    )
    return readers.benchmark_samples(b, "aime24.parquet", F.col("item_id"))


@query("A13_A14_checkpoints", "SELECT 'checkpoint-' || doc_id AS name, doc_id AS step FROM documents WHERE doc_id >= 50 AND doc_id % 3 = 0")
def a13(spark, sf):
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("checkpoint-"), _id())).otherwise(F.concat(F.lit("tmp-"), _id()))
    return readers.checkpoints(read(spark, sf, "documents").select(name.alias("name")), 50)


@query("A13_latest_checkpoint", "SELECT 'checkpoint-' || max(doc_id) AS name FROM documents")
def a13b(spark, sf):
    return readers.latest_checkpoint(read(spark, sf, "documents").select(F.concat(F.lit("checkpoint-"), _id()).alias("name")))


_NAMES = "lang || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '_t' || (doc_id % 10 / 10.0) END || '_p0.' || (doc_id % 10) || '_n' || n_chars || CASE WHEN doc_id % 2 = 0 THEN '-MNT' || (doc_id * 8) ELSE '' END || '.jsonl'"


@query(
    "X23_file_names",
    f"""WITH f AS (SELECT doc_id, {_NAMES} AS f FROM documents) SELECT doc_id, string_split(f, '_')[1] AS task, nullif(regexp_extract(f, '_t([0-9.]+)', 1), '')::DOUBLE AS temperature,
    nullif(regexp_extract(f, '_p([0-9.]+)', 1), '')::DOUBLE AS top_p, nullif(regexp_extract(f, '_n([0-9]+)', 1), '')::INT AS n, nullif(regexp_extract(f, 'MNT([0-9]+)', 1), '')::INT AS max_new_tokens FROM f""",
)
def x23(spark, sf):
    i = F.col("doc_id")
    heat = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("_t"), (i % 10 / 10.0).cast("string")))
    long = F.when(i % 2 == 0, F.concat(F.lit("-MNT"), (i * 8).cast("string"))).otherwise("")
    name = F.concat(
        "lang",
        heat,
        F.lit("_p0."),
        (i % 10).cast("string"),
        F.lit("_n"),
        F.col("n_chars").cast("string"),
        long,
        F.lit(".jsonl"),
    )
    d = read(spark, sf, "documents").select("doc_id", name.alias("name"))
    return d.select("doc_id", *[c.alias(k) for k, c in readers.file_parameters(F.col("name")).items()])


def _fresh(spark, name):
    """A new folder in what driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("A3_B2_jsonl_strict", "SELECT doc_id, text, lang, source FROM documents")
def a3(spark, sf):
    """JSON lines, written twice over, read strictly."""
    d, path = read(spark, sf, "documents").select("doc_id", "text", "lang", "source"), _fresh(spark, "strict")
    writers.write_jsonl(d.limit(1), path)
    writers.write_jsonl(d, path)
    return readers.jsonl(spark, path, "doc_id long, text string, lang string, source string")


@query(
    "B1_append_jsonl",
    "SELECT event_id % 4 AS rank, event_type AS kind, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY ALL",
)
def b1(spark, sf):
    """Two appends, a folder for each rank."""
    e, path = read(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("kind"),
        (F.col("event_id") % 4).alias("rank"),
    ), _fresh(spark, "append")
    for part in (0, 1):
        writers.append_jsonl(e.where(F.col("event_id") % 2 == part), path, "rank")
    back = readers.jsonl(spark, path, "event_id long, kind string, rank long")
    return back.groupBy("rank", "kind").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


def _lines(spark, sf):
    """A log of objects, broken lines, lists and blank lines, by id."""
    k = F.col("doc_id") % 5
    obj = F.to_json(F.struct("doc_id", "text"))
    line = F.when(k == 0, obj).when(k == 1, F.lit('{"doc_id": 1, "te')).when(
        k == 2,
        F.concat(F.lit("["), obj, F.lit("]")),
    ).when(k == 3, F.lit("  ")).otherwise(obj)
    return read(spark, sf, "documents").select(line.alias("value"))


@query("A4_jsonl_lenient", "SELECT doc_id, text FROM documents WHERE doc_id % 5 IN (0, 4)")
def a4(spark, sf):
    path = _fresh(spark, "lenient")
    _lines(spark, sf).write.text(path)
    renamed(spark, path, ".txt", ".jsonl")
    got = readers.samples(spark, path).select(F.from_json("record", "doc_id long, text string").alias("r"))
    return got.select("r.*")


@query(
    "A8_line_numbers",
    "SELECT (row_number() OVER (ORDER BY doc_id))::BIGINT AS line_number, doc_id, text FROM documents QUALIFY doc_id % 3 <> 0",
)
def a8b(spark, sf):
    """Lines of one log in parts, each read in splits, blank ones counted but left out."""
    path = _fresh(spark, "numbered")
    d = read(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.to_json(F.struct("doc_id", "text"))).alias("value"),
    )
    d.orderBy("doc_id").select("value").write.text(path)
    got = readers.numbered_lines(spark, path, as_one=True)
    return got.select("line_number", F.from_json("line", "doc_id long, text string").alias("r")).select("line_number", "r.*")


@query(
    "A5_A6_json_documents",
    "WITH l(layout, first_) AS (VALUES ('list', true), ('object', true), ('values', false)) SELECT layout, first_, item_id, text FROM l, benchmark UNION ALL SELECT 'single', false, min(item_id), arg_min(text, item_id) FROM benchmark",
)
def a5(spark, sf):
    """Documents of every layout, and one that holds no sample, found below one folder."""
    b = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("target"))
    items = F.array_sort(F.collect_list(F.struct("item_id", "target")))
    path = _fresh(spark, "layouts")
    text = b.agg(F.to_json(items).alias("j"), F.to_json(F.min(F.struct("item_id", "target"))).alias("one"))
    layouts = {
        "samples_list": F.concat(F.lit('{"samples": '), "j", F.lit("}")),
        "samples_object": F.concat(F.lit('{"samples": {"a": '), "j", F.lit(', "b": 3}}')),
        "values": F.concat(F.lit('{"x": '), "j", F.lit(', "y": [1]}')),
        "single": F.col("one"),
        "none": F.lit('{"z": [{"q": 1}]}'),
    }
    for name, value in layouts.items():
        text.select(value.alias("value")).coalesce(1).write.text(f"{path}/deep/{name}")
        renamed(spark, f"{path}/deep/{name}", ".txt", ".json", name)
    got = readers.samples(spark, path).select(
        F.regexp_extract("source_file", r"([a-z]+)-[^/]*$", 1).alias("layout"),
        F.col("samples_first").alias("first_"),
        F.from_json("record", "item_id long, target string").alias("r"),
    )
    return got.select("layout", "first_", "r.item_id", F.col("r.target").alias("text"))


@query("A5_split_documents", "SELECT doc_id, text FROM documents")
def a5_split(spark, sf):
    """Lists in eight files for each 262,144 ids, each read in splits."""
    path = _fresh(spark, "lists")
    bucket = (F.shiftright("doc_id", 18) * 8 + F.pmod("doc_id", F.lit(8))).alias("bucket")
    d = read(spark, sf, "documents").select(bucket, F.lit(1).alias("place"), F.concat(F.to_json(F.struct("doc_id", "text")), F.lit(",")).alias("value"))
    ends = d.select("bucket").distinct().select("bucket", F.explode(F.array(F.struct(F.lit(0), F.lit("[")), F.struct(F.lit(2), F.lit("null]")))).alias("x"))
    lines = d.unionByName(ends.select("bucket", F.col("x.col1").alias("place"), F.col("x.col2").alias("value")))
    lines.repartition("bucket").sortWithinPartitions("bucket", "place").drop("place").write.partitionBy("bucket").text(path)
    return large_json.objects(spark, path, "*.txt").select(F.from_json("record", "doc_id long, text string").alias("r")).select("r.*")


@query("B3_csv", "SELECT page_id::VARCHAR AS page_id, NULL::VARCHAR AS missing, url FROM pages")
def b3(spark, sf):
    path = _fresh(spark, "csv")
    writers.write_csv(read(spark, sf, "pages"), path, ["page_id", "missing", "url"])
    return spark.read.option("header", True).schema("page_id string, missing string, url string").csv(path)


@query("A12_B7_Y13_Y14_R14_R15_settings", """WITH n AS (SELECT n_nationkey AS k, n_name FROM nation)
SELECT k::BIGINT AS nation, CASE WHEN k % 2 = 0 THEN 'prefix_length' ELSE 'full_max_new_tokens' END AS length_from, (CASE WHEN k % 2 = 0 THEN 64 + k ELSE 900 END)::BIGINT AS tokens, least(2000, 512 + CASE WHEN k % 2 = 0 THEN 64 + k ELSE 900 END)::BIGINT AS longest,
n_name AS name, 3 AS kept, k::BIGINT AS changed, (CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END)::BIGINT AS problems FROM n""")
def a12(spark, sf):
    """For every nation: a file over a base file, dotted overrides, derived lengths, validation, and the dump read again."""
    base = {
        "loss_backend": "adaptive_opd",
        "strategy": "full",
        "opd_loss_mode": "prune_opd",
        "reverse_top_k": 16,
        "forward_top_k": 16,
        "overlap_top_k": 16,
        "full_max_new_tokens": 900,
        "prefix_length": 1,
        "max_length": 2000,
        "max_prompt_length": 512,
        "auto_shrink_max_length": True,
        "inner": {"kept": 3, "changed": -1},
    }
    out = []
    with tempfile.TemporaryDirectory() as top:  # settings are files of the driver
        folder = Path(top)
        config.dump(base, folder / "base.json")
        for k, name in read(spark, sf, "nation").select("n_nationkey", "n_name").collect():
            own = {"base_config": "base.json", "name": name} | ({"strategy": "esr"} if k % 2 == 0 else {}) | (
                {"beta": 1, "prune_w_base": 2} if k % 5 == 0 else {}
            )
            config.dump(own, folder / "own.json")
            cfg = config.with_lengths(config.load(folder / "own.json", [f"inner.changed={k}", f"prefix_length={64 + k}"]))
            config.dump(cfg, folder / "all.json")
            cfg = config.load(folder / "all.json")
            out.append((k, cfg["effective_max_new_tokens_source"], cfg["effective_max_new_tokens"], cfg["effective_max_length"], cfg["name"], cfg["inner"]["kept"], cfg["inner"]["changed"], len(config.problems(cfg))))
    return spark.createDataFrame(
        out,
        "nation long, length_from string, tokens long, longest long, name string, kept int, changed long, problems long",
    )


@query("B4_summary", "SELECT '{\"documents\":' || count(*) || ',\"nothing\":null}' AS json FROM documents")
def b4(spark, sf):
    return writers.summary(
        read(spark, sf, "documents").agg(F.count("*").alias("documents"), F.max(F.lit(None).cast("int")).alias("nothing"))
    )


@query(
    "B5_preview",
    "WITH c AS (SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::INT AS row, * FROM customer) " + " UNION ALL ".join(
        f"SELECT row, '{f}' AS field, {f}::VARCHAR AS value FROM c WHERE row < 5" for f in ("c_custkey", "c_name", "c_mktsegment")
    ),
)
def b5(spark, sf):
    return writers.preview_rows(read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", 5)


@query(
    "B6_shortened",
    "SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '... [' || (length(text) - 40) || ' more chars]' ELSE text END AS short FROM documents",
)
def b6(spark, sf):
    return read(spark, sf, "documents").select("doc_id", writers.shortened(F.col("text"), 40).alias("short"))
