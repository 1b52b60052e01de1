"""Views of the test tables as change sets, files, edges, scopes and messages.

The SQL is shared by Spark and DuckDB; each view names the ones it needs in {braces}.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplescope.operators import scope
from ripplescope.plans.storage import settled

VIEWS = {
    "v_files": """
SELECT p_partkey AS file_id,
       concat(CASE p_type WHEN 'STANDARD' THEN 'src' WHEN 'SMALL' THEN 'lib' WHEN 'LARGE' THEN 'src/api'
                          WHEN 'MEDIUM' THEN 'src/auth' WHEN 'ECONOMY' THEN 'tests' ELSE 'migrations' END,
              '/', CASE p_type WHEN 'ECONOMY' THEN 'test_' ELSE '' END,
              replace(p_name, ' ', '_'), '_', cast(p_partkey AS string),
              CASE p_size % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.go'
                              WHEN 4 THEN '.lock' ELSE '.min.js' END) AS path
FROM part""",
    "v_edge_ids": """
SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
WHERE a.l_discount <= 0.01 AND b.l_discount <= 0.01""",
    "v_edges": """
SELECT s.path AS src, d.path AS dst
FROM v_edge_ids e JOIN v_files s ON s.file_id = e.src JOIN v_files d ON d.file_id = e.dst""",
    "v_changes": """
SELECT g.cs AS change_set_id, cast(row_number() OVER (PARTITION BY g.cs ORDER BY f.path) AS bigint) AS ordinal,
       g.file_id, f.path AS file_path, g.added AS added_lines, g.removed AS removed_lines,
       CASE g.flag WHEN 'A' THEN 'added' WHEN 'R' THEN 'deleted' ELSE 'modified' END AS change_type,
       g.flag = 'A' AS is_new_file, g.flag = 'R' AS is_deleted
FROM (SELECT l_orderkey AS cs, l_partkey AS file_id,
             cast(sum(cast(l_quantity AS bigint)) AS bigint) AS added,
             cast(sum(cast(round(l_discount * 100) AS bigint)) AS bigint) AS removed,
             min(l_returnflag) AS flag
      FROM lineitem GROUP BY l_orderkey, l_partkey) g
JOIN v_files f ON f.file_id = g.file_id""",
    "v_scope": """
SELECT o.o_orderkey AS change_set_id, concat('fix ', p.p_name, CASE WHEN o.o_orderkey % 3 = 0 THEN '' ELSE concat(' in ', f.path) END) AS text,
       cast(CASE o.o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.8
                                   WHEN '3-MEDIUM' THEN 0.6 WHEN '4-NOT SPECIFIED' THEN 0.45 ELSE 0.3 END AS double) AS confidence,
       f.path AS target
FROM orders o
JOIN (SELECT change_set_id AS cs, min(file_id) AS file_id FROM v_changes GROUP BY change_set_id) m ON m.cs = o.o_orderkey
JOIN part p ON p.p_partkey = m.file_id JOIN v_files f ON f.file_id = m.file_id""",
    "v_messages": """
SELECT o_orderkey AS change_set_id,
       CASE o_orderkey % 5 WHEN 0 THEN 'wip' WHEN 1 THEN 'fix'
            WHEN 2 THEN concat('feat(api): add order ', cast(o_orderkey AS string))
            WHEN 3 THEN 'update the auth handling for callers' ELSE '' END AS message
FROM orders""",
}
TABLES = ("part", "lineitem", "orders")
#: Views that are read by a key again and again once they are settled.
DEALT = {"changes": "change_set_id", "scope": "change_set_id"}


def prelude(*names: str) -> str:
    """WITH clause that defines the named views and those they need, for DuckDB."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other != name and other in VIEWS[name].replace(name, ""):
                add(other)
        if name not in needed:
            needed.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)


class Adapters:
    """The views over the tables of a folder; those named in `settle` are derived once, however often they are used."""

    def __init__(self, spark: SparkSession, sf_dir: str, settle: tuple[str, ...] = ()):
        self.spark, self.sf_dir, self.settle = spark, sf_dir, settle

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or f"v_{name}" not in VIEWS:
            raise AttributeError(name)
        text = VIEWS[f"v_{name}"]
        tables = {t: self.table(t) for t in TABLES if f" {t} " in f"{text} ".replace("\n", " ")}
        views = {v: getattr(self, v[2:]) for v in VIEWS if v != f"v_{name}" and v in text}
        for key in (*tables, *views):
            text = " ".join(f"{{{w}}}" if w == key else w for w in text.replace("\n", " ").split(" "))
        found = self.spark.sql(text, **tables, **views)
        if name in self.settle:
            found = settled(found, DEALT.get(name), name == "changes")  # the last thing done to changes is to number those of a change set
            setattr(self, name, found)
        return found


_NONE = "cast(array() as array<string>)"


def nodes(a: Adapters) -> DataFrame:
    return a.files.select("path")


def changes(a: Adapters) -> DataFrame:
    return a.changes.drop("file_id").withColumn("functions_modified", F.expr(_NONE))


def scopes(a: Adapters) -> DataFrame:
    """One target, its concepts the words of the text."""
    s = a.scope
    return s.select("change_set_id", F.col("text").alias("description"), F.array("target").alias("target_files"), F.expr(_NONE).alias("target_functions"), F.array_distinct(scope.keywords(F.col("text"))).alias("target_concepts"), "confidence")
