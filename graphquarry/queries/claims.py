"""Claim queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims as C
from .registry import model, query, sql, table

_ORDER = "(PARTITION BY lower(entity), lower(attribute) ORDER BY valid_at, claim_id)"
_TEMPORAL = f"""WITH pr AS (SELECT claim_id, value, valid_at, lag(claim_id) OVER w AS before, lag(value) OVER w AS old, lag(valid_at) OVER w AS thn FROM claims WINDOW w AS {_ORDER}),
ok AS (SELECT * FROM pr WHERE thn <> '' AND thn < valid_at)
SELECT claim_id AS source, before AS target, 'supersedes' AS type FROM ok UNION ALL SELECT claim_id, before, 'contradicts' FROM ok WHERE value <> old"""


@query(_TEMPORAL)
def claims_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supersedes and contradicts edges of consecutive claims."""
    return C.temporal_edges(model(spark, sf_dir, "claims"))


@query("SELECT e AS entity, a AS attribute, claim_id, value, valid_at FROM (SELECT *, lower(entity) AS e, lower(attribute) AS a, row_number() OVER (PARTITION BY lower(entity), lower(attribute) ORDER BY valid_at DESC, claim_id DESC) AS r FROM claims) WHERE r = 1")
def claims_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest claim of each key."""
    return C.latest(model(spark, sf_dir, "claims"))


@query("SELECT e AS entity, a AS attribute, claim_id, value, valid_at FROM (SELECT *, lower(entity) AS e, lower(attribute) AS a, row_number() OVER (PARTITION BY lower(entity), lower(attribute) ORDER BY valid_at DESC, claim_id DESC) AS r FROM claims WHERE valid_at <> '' AND valid_at <= '2024-01-15') WHERE r = 1")
def claims_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims that held on a date."""
    return C.latest(model(spark, sf_dir, "claims"), "2024-01-15")


@query(
    """WITH pr AS (SELECT claim_id, value, valid_at, lag(claim_id) OVER w AS before, lag(value) OVER w AS old, lag(valid_at) OVER w AS thn FROM claims WINDOW w AS (PARTITION BY lower(entity), lower(attribute) ORDER BY claim_id)),
ok AS (SELECT * FROM pr WHERE value <> old) SELECT before AS source, claim_id AS target, 'CONTRADICTS' AS type FROM ok UNION ALL SELECT before, claim_id, 'SUPERSEDES' FROM ok WHERE thn <> '' AND valid_at <> '' AND thn < valid_at"""
)
def claims_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions in order of arrival, from the earlier claim to the new one."""
    return C.stream_edges(model(spark, sf_dir, "claims"))


_N = lambda c: f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
_KNOWN = f"kn AS (SELECT DISTINCT {_N('s')} AS s, {_N('p')} AS p, {_N('o')} AS o FROM triples), ak AS (SELECT id, {_N('s')} AS s, {_N('p')} AS p, {_N('o')} AS o FROM asked)"


@query(f"WITH {_KNOWN} SELECT id, EXISTS (SELECT 1 FROM kn WHERE kn.s = ak.s AND kn.p = ak.p AND kn.o = ak.o) AS supported FROM ak")
def triple_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims approved or rejected."""
    return C.evaluate(model(spark, sf_dir, "asked"), model(spark, sf_dir, "triples"))


@query(f"WITH {_KNOWN} SELECT p AS predicate, round(avg(CAST(EXISTS (SELECT 1 FROM kn WHERE kn.s = ak.s AND kn.p = ak.p AND kn.o = ak.o) AS INT)), 6) AS \"precision\" FROM ak GROUP BY p")
def grounding_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of approved claims by predicate."""
    asked = model(spark, sf_dir, "asked")
    both = C.evaluate(asked, model(spark, sf_dir, "triples")).join(asked.select("id", T.normal_triple_part(F.col("p")).alias("predicate")), "id")
    return both.groupBy("predicate").agg(F.round(F.avg(F.col("supported").cast("int")), 6).alias("precision"))


@query(
    f"""WITH {_KNOWN}, un AS (SELECT * FROM ak WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.s = ak.s AND kn.p = ak.p AND kn.o = ak.o)),
an AS (SELECT un.id, kn.s, kn.p, kn.o, 'predicate' AS part, kn.p AS v FROM un JOIN kn ON kn.s = un.s AND kn.o = un.o AND kn.p <> un.p UNION ALL SELECT un.id, kn.s, kn.p, kn.o, 'object', kn.o FROM un JOIN kn ON kn.s = un.s AND kn.p = un.p AND kn.o <> un.o),
fi AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, p, o) AS r FROM an)
SELECT id, s, p, o, part FROM fi WHERE r = 1 AND (SELECT count(DISTINCT v) FROM an WHERE an.id = fi.id AND an.part = fi.part) = 1"""
)
def triple_revise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected claims mended by their first anchor."""
    return C.revise(model(spark, sf_dir, "asked"), model(spark, sf_dir, "triples"))


_RESOLVE = """WITH al AS (SELECT DISTINCT alias, entity_id FROM aliases), n AS (SELECT alias, count(*) AS n, min(entity_id) AS one FROM al GROUP BY alias),
hi AS (SELECT m.mention_id, count(DISTINCT al.entity_id) AS k, min(al.entity_id) AS id FROM mentions m JOIN al ON al.alias = m.surface JOIN contexts c ON c.entity_id = al.entity_id AND c.token = m.token GROUP BY m.mention_id),
rs AS (SELECT DISTINCT m.mention_id, CASE WHEN n.n IS NULL THEN m.surface WHEN n.n = 1 THEN n.one WHEN hi.k = 1 THEN hi.id END AS id, CAST(CASE WHEN n.n IS NULL THEN 0.5 WHEN n.n = 1 THEN 0.6 WHEN hi.k = 1 THEN 0.9 ELSE 0.1 END AS DOUBLE) AS confidence
FROM mentions m LEFT JOIN n ON n.alias = m.surface LEFT JOIN hi ON hi.mention_id = m.mention_id)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.resolve(model(spark, sf_dir, "mentions"), model(spark, sf_dir, "aliases"), model(spark, sf_dir, "contexts"))


@query(f"{_RESOLVE} SELECT * FROM rs")
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface forms to entities with confidence."""
    return _resolved(spark, sf_dir)


_REL = "SELECT mention_id AS s_mention, 'knows' AS p, mention_id + 100000000 AS o_mention FROM mentions WHERE mention_id < 100000000"


@query(f"{_RESOLVE}, rl AS ({_REL}) SELECT s_mention, p, o_mention, a.id AS s, b.id AS o, a.id IS NOT NULL AND b.id IS NOT NULL AS ok FROM rl LEFT JOIN rs a ON a.mention_id = s_mention LEFT JOIN rs b ON b.mention_id = o_mention")
def add_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with both ends resolved, and failures."""
    return C.add_relations(sql(spark, sf_dir, _REL), _resolved(spark, sf_dir))


_GIVEN = "SELECT p_brand AS s, 'has_type' AS p, p_type AS o, 'doc' || (p_partkey % 4) AS source FROM part"


@query(f"WITH gv AS ({_GIVEN}) SELECT s, p, o, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM gv GROUP BY s, p, o")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and sources of triples."""
    return C.provenance(sql(spark, sf_dir, _GIVEN)).withColumn("sources", F.array_join("sources", ","))


_ANSWERS = "SELECT CAST(c_custkey AS BIGINT) AS answer_id, 'The ' || lower(c_name) || ' lives in NATION_' || c_nationkey || ' not in Atlantis' AS text FROM customer"
_NAMES = "SELECT n_name AS name FROM nation UNION ALL SELECT 'Atlantis' UNION ALL SELECT 'Customer#0000000'"


@query(
    f"""WITH an AS ({_ANSWERS}), nm AS ({_NAMES}), gr AS (SELECT lower(s) AS k FROM triples WHERE p = 'in_region' UNION SELECT lower(o) FROM triples WHERE p = 'in_region')
SELECT answer_id, name, CASE WHEN lower(name) IN (SELECT k FROM gr) THEN 'grounded' ELSE 'absent' END AS verdict FROM an JOIN nm ON contains(lower(text), lower(name))"""
)
def answer_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of an answer, grounded or absent."""
    return C.answer_entities(sql(spark, sf_dir, _ANSWERS), sql(spark, sf_dir, _NAMES), model(spark, sf_dir, "triples").filter("p = 'in_region'"))


@query("SELECT round(CAST(count(*) FILTER (node_id NOT IN (SELECT source FROM edges WHERE type = 'semantic' UNION SELECT target FROM edges WHERE type = 'semantic')) AS DOUBLE) / count(*), 6) AS ratio, CAST(count(*) FILTER (node_id NOT IN (SELECT source FROM edges WHERE type = 'semantic' UNION SELECT target FROM edges WHERE type = 'semantic')) AS DOUBLE) / count(*) > 0.5 AS regression FROM nodes")
def isolation_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of nodes without a semantic edge."""
    return C.isolation(model(spark, sf_dir, "nodes"), model(spark, sf_dir, "edges").filter("type = 'semantic'"))


@query("SELECT round(CAST(count(DISTINCT alias) AS DOUBLE) / count(DISTINCT entity_id), 6) AS ratio FROM aliases")
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases by entities."""
    return C.compression(model(spark, sf_dir, "aliases"))


_CAND = "SELECT 's:' || s_suppkey AS entity_id, CASE s_suppkey % 3 WHEN 0 THEN 'cobalt' WHEN 1 THEN 'Nova' ELSE 'zinc' END || s_suppkey AS name FROM supplier"


@query(f"WITH cd AS ({_CAND}) SELECT mention_id, entity_id FROM mentions JOIN cd ON lower(substr(surface, 1, 1)) = lower(substr(name, 1, 1))")
def block_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates blocked by first letter."""
    return C.blocks(model(spark, sf_dir, "mentions"), sql(spark, sf_dir, _CAND))


_SAID = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Yesterday ' WHEN 1 THEN 'dün' WHEN 2 THEN 'today' ELSE '' END AS said, substr(CAST(CAST(ts AS DATE) AS VARCHAR(10)), 1, 10) AS published FROM events"


@query(f"WITH sd AS ({_SAID}) SELECT event_id, strftime(CASE WHEN trim(lower(said)) IN ('yesterday', 'dün') THEN CAST(published AS DATE) - 1 ELSE CAST(published AS DATE) END, '%Y-%m-%d') AS valid_at FROM sd")
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates said relative to publication."""
    return sql(spark, sf_dir, _SAID).select("event_id", T.relative_date(F.col("said"), F.col("published")).alias("valid_at"))


_CONV_CLAIMS = """SELECT c.conv_id AS claim_id, 'topic ' || (c.conv_id % 7) AS entity, 'status' AS attribute, CAST(length(c.text) % 3 AS DOUBLE) AS value, substr(CAST(CAST(e.ts AS DATE) AS VARCHAR(10)), 1, 10) AS valid_at
FROM conversations c JOIN events e ON e.event_id = c.conv_id * 37 WHERE c.turn = 0"""


@query(
    f"""WITH cc AS ({_CONV_CLAIMS}), pr AS (SELECT claim_id, value, valid_at, lag(claim_id) OVER w AS before, lag(value) OVER w AS old, lag(valid_at) OVER w AS thn FROM cc WINDOW w AS (PARTITION BY entity, attribute ORDER BY valid_at, claim_id)),
ok AS (SELECT * FROM pr WHERE thn <> '' AND thn < valid_at) SELECT claim_id AS source, before AS target, 'supersedes' AS type FROM ok UNION ALL SELECT claim_id, before, 'contradicts' FROM ok WHERE value <> old"""
)
def conversation_temporal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal edges between conversations on one topic."""
    return C.temporal_edges(sql(spark, sf_dir, _CONV_CLAIMS))


_FORMS = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Dr. ' || p_name WHEN 1 THEN 'The ' || p_brand || ' robotic arm' WHEN 2 THEN '  a ' || p_type || '  Company ' WHEN 3 THEN p_name || '-' || p_brand || ', Inc.' WHEN 4 THEN 'dr ' || p_brand || ' robotic arm' ELSE 'An ' || upper(p_type) || '!' END AS form FROM part"


@query(
    f"""SELECT id, form, replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(form)), '^dr\\.?\\s+', ''), '\\s+robotic arm$', ''), '^(the|a|an)\\s+', ''), '^the_company$', 'nova_dynamics'), '[^a-z0-9]+', ' ', 'g')), ' ', '_') AS span FROM ({_FORMS})"""
)
def span_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface forms as keys."""
    return sql(spark, sf_dir, _FORMS).select("id", "form", T.span_key(F.col("form")).alias("span"))


_QUOTES = "SELECT p_partkey AS id, p_name || ' of ' || p_brand AS unit, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN 'absent words' ELSE p_brand END AS quote FROM part"


@query(f"WITH qu AS ({_QUOTES}) SELECT id, contains(replace(trim(regexp_replace(regexp_replace(trim(lower(unit)), '^(the|a|an)\\s+', ''), '[^a-z0-9]+', ' ', 'g')), ' ', '_'), replace(trim(regexp_replace(regexp_replace(trim(lower(quote)), '^(the|a|an)\\s+', ''), '[^a-z0-9]+', ' ', 'g')), ' ', '_')) AS in_unit FROM qu")
def quote_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations whose quote the unit really has."""
    return sql(spark, sf_dir, _QUOTES).select("id", F.contains(T.span_key(F.col("unit")), T.span_key(F.col("quote"))).alias("in_unit"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS supported FROM events")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict texts of a supplied judge as booleans; anything else is null."""
    said = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, " Supported: yes").when(F.col("event_id") % 3 == 1, "unsupported").otherwise("").alias("v"))
    return said.select("event_id", F.when(F.upper(F.trim("v")).startswith("SUPPORTED"), True).when(F.upper(F.trim("v")).startswith("UNSUPPORTED"), False).alias("supported"))
