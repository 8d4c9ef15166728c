"""Queries over whole tables, and their SQL twins where SQL can express them."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.llm.centroids import CLUSTERS, ROUNDS, centroid_clusters
from mailsieve.llm.common import table
from mailsieve.llm.conversation_repair import conversation_repair
from mailsieve.llm.embedding_dedup import embedding_dedup
from mailsieve.llm.exact_dedup import exact_dedup
from mailsieve.llm.language_id import language_id
from mailsieve.llm.licenses import HOLDS, RULES, SENTENCES, license_scan
from mailsieve.llm.line_dedup import run_dedup
from mailsieve.llm.mixing import apply_mix
from mailsieve.llm.ngram_join import ngram_join
from mailsieve.llm.quality_rules import ON_BAD, ON_GOOD, ROUNDS as EM_ROUNDS, RULES as QUALITY_RULES, WEIGHT, quality_rules
from mailsieve.llm.secret_scan import secret_scan
from mailsieve.llm.sentencepiece_codec import encode
from mailsieve.llm.token_counts import apply_edits, n_tokens, with_trees

QUERIES, ORACLE = {}, {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


ORACLE["op1_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""


@query
def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return apply_mix(table(spark, folder, "documents"))


# The SQL sorts by hash and sums, where the operator narrows histograms.
ORACLE["op5_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS volume,
    3 * source_size / weight AS ratio FROM s),
c AS (
  SELECT *, ratio <= (volume - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped FROM r),
t AS (
  SELECT source, source_size,
    CASE WHEN capped THEN cap::DOUBLE ELSE (volume - coalesce(sum(cap) FILTER (capped) OVER (), 0)) * weight
      / sum(weight) FILTER (NOT capped) OVER () END AS target FROM c),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS base FROM t),
p AS (
  SELECT *, CASE WHEN base < 3 THEN target - base * source_size ELSE 0 END AS budget FROM b),
w AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.base, p.budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached,
    sum(d.size) OVER (PARTITION BY d.source, d.hash) AS held
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * (base + CASE WHEN reached <= budget THEN 1
    WHEN reached - held <= budget AND held < 2 * (budget - (reached - held)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM w
"""


@query
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id(table(spark, folder, "documents"))


@query
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan(table(spark, folder, "documents"))


@query
def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The arrays of the operator, joined by commas."""
    found = license_scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses")
    )


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


# Sentences are found by a join here, and the rules as text of the joined identifiers.
_NORMAL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
ORACLE["op6_license_scan"] = rf"""
WITH known(form, name) AS (VALUES {_values([(form, name) for name, forms in SENTENCES.items() for form in forms])}),
rule(rank, licence, line) AS (VALUES {", ".join(f"({n}, '{licence}', ' {'  '.join(ids)} ')" for n, (licence, ids) in enumerate(RULES))}),
holds(whole, part) AS (VALUES {_values(list(HOLDS.items()))}),
split AS (
  SELECT doc_id, regexp_split_to_array(regexp_replace(text, '[.!?]+(?:[ \t\r\f\n]|\z)', chr(10) || chr(10), 'g'),
    '\n[ \t\r\f*#/%-]*\n') AS parts FROM documents),
parts AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM split),
read AS (SELECT p.*, name FROM parts p LEFT JOIN known ON form = {_NORMAL.format('part')}),
lines AS (
  SELECT doc_id, n, unnest(string_split(part, chr(10))) AS line, generate_subscripts(string_split(part, chr(10)), 1) AS m
  FROM read WHERE name IS NULL),
ids AS (
  SELECT doc_id, n, 0 AS m, name FROM read WHERE name IS NOT NULL
  UNION ALL SELECT doc_id, n, m, name FROM lines JOIN known ON form = {_NORMAL.format('line')}),
seq AS (SELECT doc_id, list(name ORDER BY n, m) AS names FROM ids GROUP BY doc_id),
hit AS (
  SELECT doc_id, licence, min(rank) AS rank FROM seq JOIN rule ON contains(' ' || array_to_string(names, '  ') || ' ', line)
  GROUP BY doc_id, licence),
found AS (
  SELECT doc_id, string_agg(licence, ',' ORDER BY rank) AS licenses FROM hit h
  WHERE NOT EXISTS (SELECT 1 FROM holds JOIN hit w ON w.licence = whole WHERE part = h.licence AND w.doc_id = h.doc_id)
  GROUP BY doc_id)
SELECT d.doc_id, coalesce(array_to_string(names, ','), '') AS sentence_ids, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN seq ON seq.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id
"""


@query
def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join(table(spark, folder, "documents"))


@query
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The text that stays of every document, and how many lines it lost."""
    return run_dedup(table(spark, folder, "documents")).select("doc_id", "text", "n_removed")


@query
def op4_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup(table(spark, folder, "embeddings"))


# All pairs of a label, where the operator compares windows and open blocks.
ORACLE["op4_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(low, vec_id), vec_id) AS component_id,
  vec_id = coalesce(least(low, vec_id), vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id
"""


def _three_edits() -> Column:
    """For every document: a word put in, characters taken out, characters replaced,
    at places that follow from its id and length."""
    size = F.coalesce(F.char_length("text"), F.lit(0))
    place = [F.pmod(F.crc32(F.concat_ws(":", F.lit(k), "doc_id").cast("binary")), size + 1).cast("int") for k in range(3)]
    edits = [(place[0], place[0], " edited text"), (place[1], place[1] + 17, ""), (place[2], place[2] + 5, "'ll\n ")]
    return F.array(*(
        F.struct(a.alias("start"), b.cast("int").alias("end"), F.lit(c).alias("insert")) for a, b, c in edits
    ))


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, before and after three edits."""
    docs = with_trees(table(spark, folder, "documents").select("doc_id", "text")).withColumn("edits", _three_edits())
    return apply_edits(docs).select(
        "doc_id", n_tokens(F.col("tree")).alias("n_tokens"), F.size("tree.chars").alias("n_leaves"),
        F.col("edited.n_tokens").alias("n_tokens_edited"), F.col("edited.n_chars").alias("n_chars_edited"),
        F.col("edited.recounted_chars").alias("recounted_chars"),
    )


@query
def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every whole text, decoded again and compared with it."""
    return encode(table(spark, folder, "documents"))


@query
def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_clusters(table(spark, folder, "embeddings"))


def _round(n: int) -> str:
    """All distances of a round and the means that follow, where the operator searches balls."""
    return f"""
a{n} AS MATERIALIZED (
  SELECT vec_id, key, e, cluster, distance FROM (
    SELECT v.vec_id, v.key, v.e, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))::BIGINT AS distance
    FROM v, c{n} c)
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY distance, cluster) = 1),
m{n} AS (
  SELECT cluster, i, ((total - ((total % n) + n) % n) // n)::BIGINT AS mean
  FROM (SELECT cluster, i, sum(e[i]) AS total, count(*) AS n FROM a{n}, range(1, 65) AS r(i) GROUP BY cluster, i)),
c{n + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{n} c
  LEFT JOIN (SELECT cluster, list(mean ORDER BY i) AS e FROM m{n} GROUP BY cluster) m ON m.cluster = c.cluster)"""


ORACLE["op13_centroid_clusters"] = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS key, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY hash) - 1 AS cluster, e
  FROM (SELECT e, sha256('1:' || vec_id::VARCHAR) AS hash FROM v ORDER BY hash LIMIT {CLUSTERS})),
{",".join(_round(n) for n in range(ROUNDS + 1))}
SELECT a.vec_id, a.cluster::INT AS cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
  sum(a.distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.cluster = a.cluster
"""


@query
def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The votes as text and the posterior to six places."""
    found = quality_rules(table(spark, folder, "documents"))
    return found.withColumn("votes", F.array_join("votes", ",")).withColumn("quality", F.round("quality", 6))


def _vote(rule: str) -> str:
    part, whole, good, bad = QUALITY_RULES[rule]
    share = f"{part}::DOUBLE / nullif({whole}, 0)"
    first, last = ("<=", ">=") if good < bad else (">=", "<=")
    return f"CASE WHEN {share} {first} {good} THEN 1 WHEN {share} {last} {bad} THEN -1 ELSE 0 END"


def _em_round(n: int) -> str:
    def rate(sign: int, weight: str, bounds: tuple[float, float, float]) -> str:
        start, least, most = bounds
        return f"""greatest({least}, least({most}, (sum(CASE WHEN v = {sign} THEN {weight} ELSE 0 END) + {WEIGHT * start})
          / (sum(CASE WHEN v <> 0 THEN {weight} ELSE 0 END) + {WEIGHT})))"""

    return f"""
q{n} AS MATERIALIZED (
  SELECT votes, any_value(n) AS n, 1 / (1 + exp(-(ln(any_value(prior) / (1 - any_value(prior)))
    + sum(CASE v WHEN 1 THEN ln(good / (1 - bad)) WHEN -1 THEN ln((1 - good) / bad) ELSE 0 END)))) AS q
  FROM ballot JOIN m{n} USING (j) GROUP BY votes),
m{n + 1} AS MATERIALIZED (
  SELECT j, (sum(q.n * q) + {WEIGHT / 2}) / (sum(q.n) + {WEIGHT}) AS prior,
    {rate(1, "q.n * q", ON_GOOD)} AS good, {rate(-1, "q.n * (1 - q)", ON_BAD)} AS bad
  FROM ballot JOIN q{n} q USING (votes) GROUP BY j)"""


ORACLE["op11_quality_rules"] = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (
  SELECT key, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS seen,
    unnest(range(1, len(words) - 6)) AS place FROM d WHERE len(words) >= 8),
twice AS (SELECT key, place FROM w QUALIFY count(*) OVER (PARTITION BY key, seen) > 1),
gap AS (SELECT key, least(8, coalesce(lead(place) OVER (PARTITION BY key ORDER BY place) - place, 8)) AS n FROM twice),
rep AS (SELECT key, sum(n)::BIGINT AS n_repeat_words FROM gap GROUP BY key),
f AS (
  SELECT key, doc_id, len(words) AS n_words, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
    len(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS n_letters, len(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
    len(regexp_replace(text, '[^!]+', '', 'g')) AS n_exclaimed, len(regexp_replace(text, '[^.!?]+', '', 'g')) AS n_ends,
    len(list_filter(words, lambda w, i: i > 1 AND w = words[i - 1])) AS n_stutter,
    len(list_filter(words, lambda w: NOT regexp_matches(w, '[\p{{L}}\p{{N}}]'))) AS n_loose
  FROM d LEFT JOIN rep USING (key)),
g AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM f),
voted AS MATERIALIZED (SELECT *, [{", ".join(_vote(rule) for rule in QUALITY_RULES)}] AS votes FROM g),
pattern AS (SELECT votes, count(*)::DOUBLE AS n FROM voted GROUP BY votes),
ballot AS MATERIALIZED (SELECT votes, n, unnest(votes) AS v, unnest(range({len(QUALITY_RULES)})) AS j FROM pattern),
m0 AS (SELECT j, 0.5 AS prior, {ON_GOOD[0]}::DOUBLE AS good, {ON_BAD[0]}::DOUBLE AS bad FROM range({len(QUALITY_RULES)}) AS r(j)),
{",".join(_em_round(n) for n in range(EM_ROUNDS + 1))}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, array_to_string(votes, ',') AS votes,
  round(q, 6) AS quality, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND q >= 0.5 AS kept
FROM voted JOIN q{EM_ROUNDS} USING (votes)
"""


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair(table(spark, folder, "conversations"))


# Bytes through the CRC's table, then one recursion along the rows, which keeps the cheapest
# edits to each state, and one along the audit, which makes the repaired text.
def _least(*options: str) -> str:
    return f"least({', '.join(options)})"


def _then(state: str, cost: str, initial: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{initial}'}}"


_ORDER = "conv_id, turn NULLS FIRST, role, text, copy"
ORACLE["op12_conversation_repair"] = f"""
WITH RECURSIVE bits(v, n, c) AS (
  SELECT v, 0, v FROM range(256) AS r(v)
  UNION ALL SELECT v, n + 1, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE n < 8),
crc AS MATERIALIZED (SELECT list(c::BIGINT ORDER BY v) AS t FROM bits WHERE n = 8),
hit AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM conversations, crc),
rows_ AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM hit, range(2) AS r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {_ORDER}) AS n FROM rows_),
judged AS MATERIALIZED (
  SELECT *, left(role, 1) AS i,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'B'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'D'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'T' ELSE '.' END AS fault
  FROM placed),
path(conv_id, n, b0, b1, b2, b3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': ''}}, {{'c': 1000000000::BIGINT, 'a': ''}},
    {{'c': 1000000000::BIGINT, 'a': ''}}, {{'c': 1000000000::BIGINT, 'a': ''}} FROM judged
  UNION ALL
  SELECT conv_id, n,
    {_then("b0", "4", "D")},
    CASE WHEN can AND i = 's' THEN {_least(_then("b1", "4", "D"), _then("b0", "cut", "K"))} ELSE {_then("b1", "4", "D")} END,
    CASE WHEN can AND i = 'u' THEN {_least(_then("c2", "4", "D"), _then("b0", "cut", "K"), _then("b1", "cut", "K"), _then("c3", "cut", "K"))}
      WHEN can THEN {_least(_then("c2", "4", "D"), _then("b0", "3 + cut", "R"), _then("b1", "3 + cut", "R"), _then("c3", "3 + cut", "R"))}
      ELSE {_then("c2", "4", "D")} END,
    CASE WHEN can AND i = 'a' THEN {_least(_then("c3", "4", "D"), _then("c2", "cut", "K"))}
      WHEN can THEN {_least(_then("c3", "4", "D"), _then("c2", "3 + cut", "R"))} ELSE {_then("c3", "4", "D")} END
  FROM (
    SELECT *, least(b3, {_then("c2", "3", "I")}) AS c3 FROM (
      SELECT p.conv_id, j.n, j.i, b0, b1, b3, j.fault IN ('.', 'T') AS can, CASE j.fault WHEN 'T' THEN 3 ELSE 0 END AS cut,
        {_least("b2", _then("b0", "3", "I"), _then("b1", "3", "I"), _then("b3", "3", "I"))} AS c2
      FROM path p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.n = p.n + 1))),
ended AS (
  SELECT conv_id, least(b0, b3, {_then("c2", "3", "I")}) AS best FROM (
    SELECT *, {_least("b2", _then("b0", "3", "I"), _then("b1", "3", "I"), _then("b3", "3", "I"))} AS c2 FROM path
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1)),
made(conv_id, audit, k, n, state, said) AS (
  SELECT conv_id, best.a, 0::BIGINT, 0::BIGINT, 'a', []::VARCHAR[] FROM ended
  UNION ALL
  SELECT conv_id, audit, k + 1, n + (op <> 'I')::BIGINT,
    CASE op WHEN 'D' THEN state WHEN 'K' THEN left(role, 1) ELSE want END,
    CASE op WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text)
      ELSE list_append(said, CASE want WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE op WHEN 'R' THEN text ELSE '' END) END
  FROM (
    SELECT m.*, audit[k + 1] AS op, CASE state WHEN 'u' THEN 'a' ELSE 'u' END AS want, j.role, j.text
    FROM made m LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM m.conv_id AND j.n = m.n + 1
    WHERE k < len(audit))),
counts AS (
  SELECT conv_id, count(*) FILTER (fault = 'B') AS blank, count(*) FILTER (fault = 'D') AS duplicate,
    count(*) FILTER (fault = 'T') AS truncated, count(*) FILTER (illegal) AS illegal FROM judged GROUP BY conv_id),
gap AS (
  SELECT conv_id, coalesce(max(turn) FILTER (kind <> 0) - min(turn) FILTER (kind <> 0) + 1 - count(DISTINCT turn) FILTER (kind <> 0), 0) AS gaps
  FROM hit GROUP BY conv_id)
SELECT g.conv_id, gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM gap g LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM g.conv_id
  LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM g.conv_id
  LEFT JOIN made m ON m.conv_id IS NOT DISTINCT FROM g.conv_id AND k = len(audit)
"""
