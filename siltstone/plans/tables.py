"""The engine's tables, derived from a folder of Parquet tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers: department by nation, role by segment, every 50th an admin."""
    c = table(spark, sf_dir, "customer")
    role = F.when(F.col("c_custkey") % 50 == 0, "admin").when(F.col("c_mktsegment") == "BUILDING", "manager").otherwise("viewer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("full_name"), role.alias("role"), F.col("c_mktsegment").alias("team_name"), F.concat(F.lit("n"), "c_nationkey").alias("department_id"))


def departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their nations below them."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("department_id"), F.lit(None).cast("string").alias("parent_id"), F.concat(F.lit("r"), "r_regionkey").alias("id_path"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("department_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("id_path"), F.col("n_name").alias("name"))
    return r.unionByName(n)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("document_id"), F.concat("source", F.lit("-"), "doc_id").alias("title"), (F.col("doc_id") % 40).alias("owner_user_id"), "lang", "source", F.col("text").alias("content"))


def acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACL rows by rules on doc_id: public, one user, managers, a nation, a region (managing), a legacy team, and rows
    that grant nothing."""
    d = F.col("doc_id")
    none = F.lit(None)

    def row(rule: int, kind: str, user=none, role=none, team=none, dept=none, view=True, manage=False):
        return F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("principal_type"), user.cast("long").alias("user_id"), role.cast("string").alias("role"), team.cast("string").alias("team_name"), dept.cast("string").alias("department_id"), F.lit(view).alias("can_view"), F.lit(manage).alias("can_manage"))

    rules = F.array_compact(
        F.array(
            F.when(d % 25 == 0, row(1, "public")),
            F.when(d % 5 == 1, row(2, "user", user=d % 150)),
            F.when(d % 50 == 2, row(3, "role", role=F.lit("manager"))),
            F.when(d % 5 == 3, row(4, "team", dept=F.concat(F.lit("n"), d % 25))),
            F.when(d % 35 == 0, row(5, "team", dept=F.concat(F.lit("r"), d % 5), view=False, manage=True)),
            F.when(d % 55 == 0, row(6, "team", team=F.lit("MACHINERY"))),
            F.when(d % 13 == 0, row(7, "user", user=d % 100, view=False)),
        )
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(rules).alias("r"))
    return rows.select((d * 10 + F.col("r.rule")).alias("acl_id"), F.col("doc_id").alias("document_id"), "r.*").drop("rule")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each line of a document."""
    d = documents(spark, sf_dir)
    rows = d.select("document_id", F.col("title").alias("document_title"), F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("chunk_index", "content"))
    return rows.where(F.trim("content") != "").withColumn("chunk_id", F.concat_ws("-", "document_id", "chunk_index"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


def work_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a sentence after each that names work, an urgent matter, or a risk, by turn."""
    n = F.col("turn") % 3
    more = F.when(n == 0, F.concat(F.lit(". must update page "), (F.col("session_id") % 7).cast("string"), F.lit("."))).when(n == 1, F.concat(F.lit(". The SLA review is urgent; notify owner "), F.col("turn").cast("string"), F.lit("."))).otherwise(". No risk, no delay.")
    return messages(spark, sf_dir).withColumn("content", F.concat("content", more))


#: The same rules for the SQL side.
VIEWS = r"""
users AS (SELECT c_custkey AS user_id, c_name AS full_name, CASE WHEN c_custkey % 50 = 0 THEN 'admin' WHEN c_mktsegment = 'BUILDING' THEN 'manager' ELSE 'viewer' END AS role,
          c_mktsegment AS team_name, 'n' || c_nationkey AS department_id FROM customer),
departments AS (SELECT 'r' || r_regionkey AS department_id, NULL AS parent_id, 'r' || r_regionkey AS id_path, r_name AS name FROM region
          UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'r' || n_regionkey || '/n' || n_nationkey, n_name FROM nation),
docs AS (SELECT doc_id AS document_id, source || '-' || doc_id AS title, doc_id % 40 AS owner_user_id, lang, source, text AS content FROM documents),
acl AS (SELECT doc_id * 10 + 1 AS acl_id, doc_id AS document_id, 'public' AS principal_type, NULL::BIGINT AS user_id, NULL AS role, NULL AS team_name, NULL AS department_id, true AS can_view, false AS can_manage FROM documents WHERE doc_id % 25 = 0
  UNION ALL SELECT doc_id * 10 + 2, doc_id, 'user', doc_id % 150, NULL, NULL, NULL, true, false FROM documents WHERE doc_id % 5 = 1
  UNION ALL SELECT doc_id * 10 + 3, doc_id, 'role', NULL, 'manager', NULL, NULL, true, false FROM documents WHERE doc_id % 50 = 2
  UNION ALL SELECT doc_id * 10 + 4, doc_id, 'team', NULL, NULL, NULL, 'n' || (doc_id % 25), true, false FROM documents WHERE doc_id % 5 = 3
  UNION ALL SELECT doc_id * 10 + 5, doc_id, 'team', NULL, NULL, NULL, 'r' || (doc_id % 5), false, true FROM documents WHERE doc_id % 35 = 0
  UNION ALL SELECT doc_id * 10 + 6, doc_id, 'team', NULL, NULL, 'MACHINERY', NULL, true, false FROM documents WHERE doc_id % 55 = 0
  UNION ALL SELECT doc_id * 10 + 7, doc_id, 'user', doc_id % 100, NULL, NULL, NULL, false, false FROM documents WHERE doc_id % 13 = 0),
lines AS (SELECT document_id, title, unnest(string_split(coalesce(content, ''), chr(10))) AS content, generate_subscripts(string_split(coalesce(content, ''), chr(10)), 1) - 1 AS chunk_index FROM docs),
chunks AS (SELECT document_id, title AS document_title, chunk_index, content, document_id || '-' || chunk_index AS chunk_id FROM lines WHERE trim(content) <> ''),
queries AS (SELECT item_id AS query_id, text AS query_text FROM benchmark),
messages AS (SELECT conv_id AS session_id, turn, role, text AS content FROM conversations),
closure AS (SELECT department_id, unnest(string_split(id_path, '/')) AS ancestor_id FROM departments),
people AS (SELECT * FROM users WHERE role <> 'admin'),
grants AS (
  SELECT u.user_id, a.document_id, 'acl' AS source, a.acl_id, a.can_manage,
    CASE a.principal_type WHEN 'public' THEN 'public' WHEN 'user' THEN 'user' WHEN 'role' THEN 'role' END AS match_type
  FROM people u JOIN acl a ON a.principal_type = 'public' OR (a.principal_type = 'user' AND a.user_id = u.user_id) OR (a.principal_type = 'role' AND a.role = u.role)
  WHERE a.can_view OR a.can_manage
  UNION ALL
  SELECT u.user_id, a.document_id, 'acl', a.acl_id, a.can_manage, CASE WHEN a.department_id = u.department_id THEN 'direct' ELSE 'ancestor' END
  FROM people u JOIN closure c ON c.department_id = u.department_id JOIN acl a ON a.principal_type = 'team' AND a.department_id = c.ancestor_id WHERE a.can_view OR a.can_manage
  UNION ALL
  SELECT u.user_id, a.document_id, 'acl', a.acl_id, a.can_manage, 'legacy' FROM people u JOIN acl a ON a.principal_type = 'team' AND a.team_name = u.team_name WHERE a.can_view OR a.can_manage
  UNION ALL
  SELECT u.user_id, d.document_id, 'owner', NULL, true, 'owner' FROM people u JOIN docs d ON d.owner_user_id = u.user_id),
decisions AS (SELECT user_id, document_id, bool_or(can_manage) AS can_manage,
    coalesce(max(CASE WHEN source = 'owner' THEN 'owner' END), min_by(match_type, acl_id)) AS reason FROM grants GROUP BY ALL),
folded AS (SELECT *, replace(lower(content), 'ß', 'ss') AS low FROM chunks),
raw_terms AS (
  SELECT chunk_id, 0 AS field, 6 AS weight, unnest(regexp_extract_all(lower(document_title), '[a-z0-9]+')) AS term FROM chunks
  UNION ALL SELECT chunk_id, 1, 1, unnest(regexp_extract_all(low, '[a-z0-9]+')) FROM folded),
terms AS (SELECT chunk_id, term, least(sum(weight), 12)::INT AS tf FROM raw_terms GROUP BY ALL),
qt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(replace(lower(query_text), 'ß', 'ss'), '[a-z0-9]+')) AS term FROM queries) WHERE NOT regexp_full_match(term, '[0-9]{1,2}')),
qterms AS (SELECT query_id, term, 1 AS qtf, count(*) OVER (PARTITION BY query_id) AS n_terms FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY regexp_matches(term, '[0-9]') DESC, length(term) DESC, term DESC) AS n FROM qt) WHERE n <= 64),
doc_len AS (SELECT chunk_id, sum(tf) AS doc_len FROM terms GROUP BY 1),
size AS (SELECT count(*) AS n_chunks, avg(doc_len) AS avg_len FROM doc_len),
df AS (SELECT term, count(*) AS df FROM terms GROUP BY 1)
"""
