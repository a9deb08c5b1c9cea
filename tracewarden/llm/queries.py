"""Registered queries of the corpus operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewarden.llm import chat_format, exact_dedup, fingerprint, line_dedup, lm_score, minhash_dedup, mixing, packing, periodic_runs, phrases, quality, sharding, simhash_dedup
from tracewarden.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query(
    "op4_exact_dedup",
    f"""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(normal) AS text_sha256
    FROM (SELECT doc_id, {ASCII_LOWER} AS normal FROM documents)
    WINDOW same AS (PARTITION BY normal)
    """,
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_mixing")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


CONTROLS = r"\### Assistant: </turn> ok"


@query(
    "op1_chat_format",
    r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
    ), sized AS (
        SELECT *, length('<turn:></turn>') + 1 + length(role) + length(role) - length(translate(role, '\<>', '')) + length(text)
            + length(text) - length(replace(text, '\', ''))
            + (length(text) - length(replace(text, '<turn:', ''))) // 6
            + (length(text) - length(replace(text, '</turn>', ''))) // 7
            + (length(text) - length(replace(text, '<part:', ''))) // 6 AS chars
        FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(chars)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id
    """,
)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", CONTROLS), (-7, 1, "assistant", CONTROLS)], "conv_id long, turn long, role string, text string")
    return chat_format.conversation_digests(chat_format.format_turns(turns.unionByName(planted)))


@query("op8_fingerprint")
def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


@query("op7_lm_score")
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_decisions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = line_dedup.line_decisions(table(spark, sf_dir, "documents"))
    return decisions.select("doc_id", "line_no", "keep_doc_id", "keep_line_no", "group_size", "kept")


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = periodic_runs.periodic_runs(periodic_runs.with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", periodic_runs.longest_run())
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query(
    "op11_minhash_near_dedup",
    rf"""
    WITH RECURSIVE words AS MATERIALIZED (
        SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
    ), sets AS MATERIALIZED (
        SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s
        FROM words
    ), classes AS MATERIALIZED (
        SELECT row_number() OVER () AS id, s, first FROM (SELECT list_sort(s) AS s, min(doc_id) AS first FROM sets WHERE len(s) > 0 GROUP BY 1)
    ), items AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS x FROM classes
    ), pairs AS MATERIALIZED (
        SELECT l.id AS a, r.id AS b FROM items l JOIN items r ON l.x = r.x AND l.id < r.id
        GROUP BY l.id, r.id HAVING 100 * count(*) >= 80 * (min(l.n) + min(r.n) - count(*))
    ), links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
    ), reached(id, other) AS (
        SELECT id, id FROM classes UNION SELECT reached.id, links.b FROM reached JOIN links ON reached.other = links.a
    ), roots AS (
        SELECT reached.id, min(classes.first) AS component_id FROM reached JOIN classes ON reached.other = classes.id GROUP BY 1
    ), found AS (
        SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(roots.component_id, sets.doc_id) AS component_id
        FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN roots ON classes.id = roots.id
    )
    SELECT *, doc_id = component_id AS kept, count(*) OVER (PARTITION BY component_id) AS component_size FROM found
    """,
)
def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


@query(
    "op12_phrases",
    rf"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({ASCII_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
    ), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
    ), sizes AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS size FROM words
    ), starts AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sizes WHERE len(w) >= size
    ), counts AS MATERIALIZED (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS a FROM starts GROUP BY ALL
    ), frequent AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE a >= 30
    ), cuts AS (
        SELECT lang, phrase, size, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : size], ' ') AS tail
        FROM (SELECT *, unnest(range(1, size)) AS k FROM frequent WHERE size >= 2)
    ), scored AS (
        SELECT c.*, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
        FROM cuts c JOIN frequent l ON c.lang = l.lang AND c.head = l.phrase JOIN frequent r ON c.lang = r.lang AND c.tail = r.phrase
    ), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ), inner_sizes AS (SELECT lang, w, size, a, unnest(range(2, size)) AS part FROM frequent WHERE size >= 3
    ), inner_starts AS (SELECT *, unnest(range(1, size - part + 2)) AS i FROM inner_sizes
    ), covers AS (SELECT lang, array_to_string(w[i : i + part - 1], ' ') AS phrase, max(a) AS cover FROM inner_starts GROUP BY ALL
    ), kept AS (
        SELECT lowest.* FROM lowest LEFT JOIN covers ON lowest.lang = covers.lang AND lowest.phrase = covers.phrase
        WHERE cover IS NULL OR 100 * cover < 80 * a
    ), totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang
    ), ranked AS (
        SELECT kept.*, n, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank
        FROM kept JOIN totals ON kept.lang = totals.lang
    )
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
    """,
)
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=30, longest=4, swallow=80, top=2000)
