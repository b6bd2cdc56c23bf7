"""The registry's contents and the bindings of the note model to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.operators.resolve import meet

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the tables: called with ``read``, which gives a table by name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


# notes: the parts, in a folder for each brand, with their name as alias
PARTS_SQL = "SELECT p_partkey, p_brand || '/part-' || p_partkey || '.md' AS path, p_name AS alias, 'Own Part ' || p_partkey AS alias2, p_brand AS domain FROM part"


def part_notes(read) -> DataFrame:
    path = F.concat("p_brand", F.lit("/part-"), F.col("p_partkey").cast("string"), F.lit(".md"))
    return read("part").select("p_partkey", path.alias("path"), F.array("p_name", F.concat(F.lit("Own Part "), F.col("p_partkey").cast("string"))).alias("aliases"), F.col("p_brand").alias("domain"))


# links: orders cite the parts of their lines
EDGES_SQL = "SELECT l_orderkey, l_partkey, l_linenumber, o_orderstatus = 'F' AS from_map FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def edges(read) -> DataFrame:
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return meet(lines, read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey").select("l_orderkey", "l_partkey", "l_linenumber", (F.col("o_orderstatus") == "F").alias("from_map"))


# notes: the documents, in folders of source and language, titled by their first line
DOCS_SQL = """SELECT doc_id, source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 6, '0') || '.md' AS path, split_part(text, chr(10), 1) AS title, text, lang AS domain, source, n_chars FROM documents"""


def doc_notes(read) -> DataFrame:
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".md"))
    return read("documents").select("doc_id", path.alias("path"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text", F.col("lang").alias("domain"), "source", "n_chars")


# findings: the events, each kind as a rule; the target is props.k, which every eleventh lacks
RULES = {"error": "schema.frontmatter", "purchase": "link.broken", "click": "link.title_not_alias", "view": "link.broken.path", "signup": "schema.navigation_unavailable"}
FINDINGS_SQL = f"""SELECT event_id AS seq, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in RULES.items())} END AS rule_id,
    CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 WHEN 'click' THEN (event_id % 2)::INTEGER ELSE 0 END AS severity,
    'user-' || user_id AS path, 'd' || (user_id % 7) AS domain, CASE WHEN event_id % 11 <> 0 THEN 'K' || json_extract_string(props, '$.k') END AS target, (user_id % 5)::INTEGER AS line, ts FROM events"""


def findings(read) -> DataFrame:
    kind = F.col("event_type")
    level = F.when(kind == "error", 2).when(kind == "purchase", 1).when(kind == "click", (F.col("event_id") % 2).cast("int")).otherwise(0)
    rule = F.create_map(*(F.lit(x) for pair in RULES.items() for x in pair))[kind]
    return read("events").select(
        F.col("event_id").alias("seq"), rule.alias("rule_id"), level.alias("severity"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("path"), F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string")).alias("domain"),
        F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("K"), F.get_json_object("props", "$.k"))).alias("target"), (F.col("user_id") % 5).cast("int").alias("line"), "ts",
    )
