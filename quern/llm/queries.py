"""Queries opN_<name> over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the 50-byte strings that a document of a smaller id has: counts and digest of what is left."""
    from quern.llm.suffix_dedup import remove_repeats

    cut = remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"], with_text=False)
    return cut.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each document's shingle set, its component of near duplicates, and whether it is the one that stays."""
    from quern.llm.minhash_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, up to three words in 13 being others, with the place."""
    from quern.llm.decontaminate import leaks

    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


#: (host, path, verdict): the rules of op4.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest fitting rule and verdict of each page."""
    from quern.llm.url_filter import url_verdicts

    return url_verdicts(_read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


_OP4_SQL = """
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM p),
q AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT q.*, r.h || r.p AS rule, r.v, row_number() OVER (PARTITION BY q.page_id ORDER BY length(r.h || r.p) DESC NULLS LAST, r.h || r.p) AS k
  FROM q LEFT JOIN rules r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.p))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0: not for learning."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document from its nearest labelled examples, learned without the held-out ids."""
    from quern.llm.toxicity import fit, scored

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    out = scored(docs, fit(docs, labels), columns=["doc_id"])
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned without the held-out ids."""
    from quern.llm.language import fit, identified

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identified(docs.select("doc_id", "text"), fit(docs.where(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: Labels that are broadcast at most; more of them meet the documents in a shuffle.
BROADCAST_LABELS = 2_000_000


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches and a compaction.

    All documents come in; those labelled toxic go again; those labelled of low
    quality move to the source ``low`` with blanks trimmed; the batch of toxic
    ones is sent a second time, which changes nothing.
    """
    from quern.llm.scratch import Scratch
    from quern.llm.token_counts import Rollup, deltas, signed

    rollup = Rollup(spark, Scratch(spark).folder)
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    labels = _read(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"),
        F.min("quality").alias("quality"),
    )
    if labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        labels = F.broadcast(labels)
    marked = docs.join(labels, "doc_id")
    toxic = marked.where("toxic = 1").select(F.lit("delete").alias("op"), "source", "lang", "text")
    old = [F.col(c).alias(f"old_{c}") for c in ("source", "lang", "text")]
    low = marked.where("quality = 0 and coalesce(toxic, 0) <> 1").select(
        F.lit("revise").alias("op"),
        F.lit("low").alias("source"),
        "lang",
        F.trim("text").alias("text"),
        *old,
    )
    rollup.commit("arrivals", deltas(signed(docs.select(F.lit("insert").alias("op"), "source", "lang", "text"))))
    rollup.commit("toxic", deltas(signed(toxic)))
    rollup.commit("low", deltas(signed(low)))
    rollup.commit("toxic", deltas(signed(toxic)))
    rollup.compact()
    return rollup.totals()


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each vector of equal label at cosine 0.98 and more, its component, and whether it stays."""
    from quern.llm.embedding_dedup import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in as few sequences of 2,048 tokens as can be found."""
    from quern.llm.packing_bins import pack_sequences

    return pack_sequences(_read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document, shards of nearly equal bytes, equal texts together."""
    from quern.llm.sharding import shard

    return shard(_read(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures of each document, and whether the base and the cascade of rules keep it."""
    from quern.llm.quality_rules import FIGURES, judged, learned_order

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, ["doc_id"], learned_order(docs)).select("row.doc_id", *FIGURES, "base_failed", "kept")


_WORDS = r"'[^\x20\x09-\x0D]+'"
_OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, {_WORDS}) AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS l FROM d),
p AS (SELECT k, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS i FROM w),
q AS (SELECT k, i, a, lead(a, 1) OVER s AS b, lead(a, 2) OVER s AS c FROM p WINDOW s AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM q WHERE c IS NOT NULL),
x AS (SELECT DISTINCT k, i + j AS i FROM r, (VALUES (0), (1), (2)) v(j) WHERE n > 1),
reps AS (SELECT k, count(*) AS n_repeat_words FROM x GROUP BY k),
top AS (SELECT k, max(n) AS top FROM (SELECT k, a, count(*) AS n FROM p GROUP BY k, a) GROUP BY k),
f AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(top, 0) AS top,
  len(regexp_extract_all(t, '[^\x20\x09-\x0D]*\p{{L}}[^\x20\x09-\x0D]*')) AS lettered, length(regexp_replace(t, '\P{{L}}', '', 'g')) AS letters,
  length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS capitals, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits
  FROM w LEFT JOIN reps USING (k) LEFT JOIN top USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR 5 * lettered < 4 * n_words OR 2 * n_dup_lines > n_lines OR 2 * capitals > letters
    OR 2 * digits > word_chars OR 10 * top > 3 * n_words OR NOT word_chars BETWEEN 2 * n_words AND 15 * n_words) AS kept
FROM b
"""


def op12_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest lines of other items for each item, and sums over all near ones."""
    from quern.llm.band_join import near_items

    return near_items(_read(spark, sf_dir, "sale_lines"), _read(spark, sf_dir, "items"))


#: CRC-32 of short ASCII texts: a table of 256 entries by its rule, then a fold over the bytes.
_CRC_SQL = """
tab(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8),
crc(t) AS (SELECT list(c ORDER BY i) FROM tab WHERE k = 8)"""


def _crc_sql(text: str) -> str:
    bytes_ = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295)"


_OP12_SQL = f"""
WITH RECURSIVE {_CRC_SQL},
c AS (SELECT sale_id, line_no, item_id AS line_item_id, quantity::BIGINT AS q, floor(100 * amount + 0.5)::BIGINT AS a FROM sale_lines
  WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity IS NOT NULL AND amount IS NOT NULL),
l AS (SELECT sale_id, line_no::BIGINT AS line_no, line_item_id, ((2 * a + q) - ((2 * a + q) % (2 * q) + 2 * q) % (2 * q)) // (2 * q) AS u,
  {_crc_sql("sale_id || ',' || line_no || ',' || line_item_id")} AS crc FROM c, crc),
i AS (SELECT row_number() OVER () AS k, item_id, floor(100 * price + 0.5)::BIGINT AS p FROM items),
w AS (SELECT *, p - greatest(10, p // 500) AS low, p + greatest(10, p // 500) AS high FROM i),
pairs AS (SELECT k, item_id, abs(u - p) AS gap, u, sale_id, line_no, line_item_id, crc FROM w JOIN l ON u BETWEEN low AND high WHERE line_item_id <> item_id),
sums AS (SELECT k, count(*) AS n, sum(gap)::BIGINT AS gaps, sum(crc)::BIGINT AS crcs FROM pairs GROUP BY k),
first AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gap, u, sale_id, line_no, line_item_id) AS rank FROM pairs)
SELECT i.item_id, coalesce(rank, 0)::INTEGER AS rank, gap, u, sale_id, line_no, line_item_id,
  coalesce(n, 0) AS n_pairs, coalesce(gaps, 0) AS gap_sum, coalesce(crcs, 0) AS lines_crc
FROM i LEFT JOIN sums USING (k) LEFT JOIN (SELECT * FROM first WHERE rank <= 5) f USING (k)
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for each document; of a third of them the text is held against the manifest in lower case."""
    from quern.llm.merkle import manifest

    docs, columns = _read(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    claimed = {"text": F.when(third, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))}
    return manifest(docs, columns, "lang", "doc_id", claimed).withColumnRenamed("key", "doc_id")


def _op13_sql(levels: int = 8) -> str:
    """Levels of both trees one by one; a group that is down to one node goes through unchanged."""

    def leaf(text: str) -> str:
        sized = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(sized)})"

    low = f"translate(text, '{_UPPER}', '{_LOWER}')"
    out = [
        f"WITH RECURSIVE {_CRC_SQL}",
        f"l AS (SELECT *, coalesce('=' || lang, '') AS g, {leaf('text')} AS leaf, "
        f"CASE WHEN {_crc_sql('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS claim FROM documents, crc)",
        "d0 AS (SELECT doc_id, leaf, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, claim AS fold, '' AS proof FROM l)",
        "n0 AS (SELECT g, i, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM d0)",
    ]

    def up(k: int, n: str, d: str) -> list[str]:
        """Nodes and documents of the next level, from those of level k."""
        left, right = "array_to_string(run[1:(i % 8)::INT], '')", "array_to_string(run[(i % 8 + 2)::INT:8], '')"
        return [
            f"r{n}{k} AS (SELECT g, i // 8 AS j, any_value(n) AS n, list(node ORDER BY i) AS run FROM {n}{k} GROUP BY g, i // 8)",
            f"{n}{k + 1} AS (SELECT g, j AS i, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS node, (n + 7) // 8 AS n FROM r{n}{k})",
            f"{d}{k + 1} AS (SELECT x.* REPLACE (i // 8 AS i, CASE WHEN n > 1 THEN sha256({left} || fold || {right}) ELSE fold END AS fold, "
            f"CASE WHEN n > 1 THEN proof || {left} || {right} ELSE proof END AS proof) FROM {d}{k} x JOIN r{n}{k} r ON r.g = x.g AND r.j = x.i // 8)",
        ]

    for k in range(levels):
        out += up(k, "n", "d")
    subroots = f"(SELECT g AS name, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM n{levels})"
    out += [
        f"m0 AS (SELECT '' AS g, i, subroot AS node, count(*) OVER () AS n FROM {subroots})",
        f"e0 AS (SELECT doc_id, leaf, subroot, '' AS g, s.i, fold, proof FROM d{levels} JOIN {subroots} s ON s.name = d{levels}.g)",
    ]
    for k in range(levels):
        out += up(k, "m", "e")
    return ",\n".join(out) + f"""
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = node AS verified FROM e{levels}, m{levels}"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_minhash_dedup": op2_minhash_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_url_filters": op4_url_filters,
        "op5_token_counts": op5_token_counts,
        "op6_toxicity": op6_toxicity,
        "op7_language_id": op7_language_id,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_sharding": op9_sharding,
        "op10_packing": op10_packing,
        "op11_quality_rules": op11_quality_rules,
        "op12_band_join": op12_band_join,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filters": _OP4_SQL, "op11_quality_rules": _OP11_SQL, "op12_band_join": _OP12_SQL, "op13_merkle": _op13_sql()}
