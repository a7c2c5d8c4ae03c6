"""Relations that the registered queries work on, each built from the given tables, and SQL for the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(kind: str, column: str) -> F.Column:
    return F.concat(F.lit(f"{kind}/"), F.col(column).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on what: orders on customers and suppliers, those on nations, nations on regions. Repeated edges stay."""
    t = lambda n: read(spark, sf_dir, n)
    pairs = [
        t("orders").select(_key("order", "o_orderkey").alias("src"), _key("cust", "o_custkey").alias("dst")),
        t("lineitem").select(_key("order", "l_orderkey").alias("src"), _key("supp", "l_suppkey").alias("dst")),
        t("customer").select(_key("cust", "c_custkey").alias("src"), _key("nation", "c_nationkey").alias("dst")),
        t("supplier").select(_key("supp", "s_suppkey").alias("src"), _key("nation", "s_nationkey").alias("dst")),
        t("nation").select(_key("nation", "n_nationkey").alias("src"), _key("region", "n_regionkey").alias("dst")),
    ]
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out


EDGES = """all_edges AS (
  SELECT 'order/' || o_orderkey AS src, 'cust/' || o_custkey AS dst FROM orders
  UNION ALL SELECT 'order/' || l_orderkey, 'supp/' || l_suppkey FROM lineitem
  UNION ALL SELECT 'cust/' || c_custkey, 'nation/' || c_nationkey FROM customer
  UNION ALL SELECT 'supp/' || s_suppkey, 'nation/' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation),
edges AS (SELECT DISTINCT src, dst FROM all_edges),
nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph with cycles, loops and chains: the type of a user's event leads to that of the user's next event of the hour."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").withColumn("hour", F.hour("ts"))
    following = F.lead("event_type").over(Window.partitionBy("user_id", "hour").orderBy("ts", "event_id"))
    pairs = e.select("user_id", "event_type", following.alias("then")).filter("then is not null")
    return pairs.select(F.concat_ws("/", "event_type", "user_id").alias("src"), F.concat_ws("/", "then", "user_id").alias("dst"))


FLOWS = """flows AS (
  SELECT event_type || '/' || user_id AS src, following || '/' || user_id AS dst FROM (
    SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id, hour(ts) ORDER BY ts, event_id) AS following FROM events)
  WHERE following IS NOT NULL)"""


def libraries(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """Two ecosystems of libraries: parts of even and of odd keys, tagged by the words of their names and their brand."""
    p = read(spark, sf_dir, "part").filter(F.col("p_partkey") % 2 == side)
    named = p.select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"), F.col("p_type").alias("lib_type"), F.concat(F.split("p_name", " "), F.array("p_brand")).alias("tags"))
    return named.distinct()


LIBRARIES = """libs AS (
  SELECT DISTINCT p_partkey % 2 AS side, p_name || ' ' || p_brand || ' ' || p_type AS name, p_type AS lib_type, list_distinct(string_split(p_name, ' ') || [p_brand]) AS tags FROM part)"""


def symbols(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """Two versions of a project: customers are modules; each order priority they use is a symbol, whose parts are orders.

    The first version has the orders up to 1998, the second all from 1997 on."""
    o = read(spark, sf_dir, "orders").filter(F.col("o_orderdate") < "1998-01-01" if version == 0 else F.col("o_orderdate") >= "1997-01-01")
    by = o.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderstatus").alias("status"), F.array_sort(F.collect_set("o_orderstatus")).alias("kinds"), F.max(F.floor("o_totalprice")).cast("long").alias("value"))
    param = F.transform(F.col("kinds"), lambda k: F.struct(F.concat(F.lit("p"), k).alias("name"), F.when(F.col("n") > 1, "many").otherwise("one").alias("type"), (F.col("n") > 2).alias("optional")))
    return by.select(
        F.concat(F.lit("cust/"), "o_custkey").alias("module"), F.col("o_orderpriority").alias("name"), F.when(F.substring("o_orderpriority", 1, 1) < "3", "function").otherwise("const").alias("kind"),
        F.col("first").alias("ordinal"), F.lit(0).cast("long").alias("line_start"), F.col("n").alias("line_end"), param.alias("params"), F.col("status").alias("return_type"), (F.col("n") > 1).alias("is_async"),
        F.when(F.col("value") % 2 == 0, F.col("value").cast("string")).alias("value"), F.when(F.col("n") > 1, F.concat(F.lit("doc "), "n")).alias("doc"), F.array().cast("array<string>").alias("attributes"),
        F.transform("kinds", lambda k: F.struct(F.when(k == "F", "method").otherwise("property").alias("kind"), k.alias("name"))).alias("children"),
    )


def _symbols_sql(name: str, where: str) -> str:
    return f"""{name} AS (
  SELECT 'cust/' || o_custkey AS module, o_orderpriority AS name, CASE WHEN substr(o_orderpriority, 1, 1) < '3' THEN 'function' ELSE 'const' END AS kind,
    min(o_orderkey) AS ordinal, count(*) AS n, max(o_orderstatus) AS return_type, list_sort(list_distinct(list(o_orderstatus))) AS kinds,
    CAST(max(floor(o_totalprice)) AS BIGINT) AS price FROM orders WHERE {where} GROUP BY 1, 2, 3)"""


SYMBOLS = _symbols_sql("old", "o_orderdate < '1998-01-01'") + ",\n" + _symbols_sql("new", "o_orderdate >= '1997-01-01'")


def packages(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """Two lists of versioned packages: suppliers by what was returned of them, if their balance isn't negative, and by what was accepted, but for
    those of one nation. The version counts the quantities and the seventh lines."""
    s = read(spark, sf_dir, "supplier").filter("s_acctbal >= 0" if version == 0 else "s_nationkey <> 7").select(F.col("s_suppkey").alias("l_suppkey"))
    li = read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == ("R" if version == 0 else "A")).join(s, "l_suppkey")
    by = li.groupBy("l_suppkey").agg(F.count_distinct("l_quantity").alias("n"), F.count_if(F.col("l_linenumber") == 7).alias("m"))
    return by.select(F.concat(F.lit("supp/"), "l_suppkey").alias("package"), F.concat(F.lit("v"), F.floor(F.col("n") / 3), F.lit("."), F.col("n") % 3, F.lit("."), "m").alias("version"))


def _packages_sql(name: str, where: str) -> str:
    return f"""{name} AS (
  SELECT 'supp/' || l_suppkey AS package, n // 3 AS major, n % 3 AS minor, 'v' || (n // 3) || '.' || (n % 3) || '.' || m AS version FROM (
    SELECT l_suppkey, count(DISTINCT l_quantity) AS n, count(*) FILTER (WHERE l_linenumber = 7) AS m FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE {where} GROUP BY 1))"""


PACKAGES = _packages_sql("po", "l_returnflag = 'R' AND s_acctbal >= 0") + ",\n" + _packages_sql("pn", "l_returnflag = 'A' AND s_nationkey <> 7")


def level(number: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, ("full", "partial", "none", "unknown"))), (number % 4 + 1).cast("int"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work on users: the layer by id, the in-degree by number of events."""
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("in_degree"))
    return e.select(F.concat(F.lit("user/"), "user_id").alias("module"), (F.col("user_id") % 3).alias("layer"), "in_degree")


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "purchase", F.when(F.col("value") > 100, "verified").otherwise("done")).when(F.col("event_type") == "error", "failed").otherwise("in_progress")
    return read(spark, sf_dir, "events").select(F.concat(F.lit("user/"), "user_id").alias("module"), F.col("event_id").alias("at"), status.alias("status"))


TASKS = """tasks AS (SELECT 'user/' || user_id AS module, user_id % 3 AS layer, count(*) AS in_degree FROM events GROUP BY 1, 2),
task_events AS (SELECT 'user/' || user_id AS module, event_id AS at, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN CASE WHEN value > 100 THEN 'verified' ELSE 'done' END WHEN 'error' THEN 'failed' ELSE 'in_progress' END AS status FROM events)"""


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script files written from the tables: one for each supplier, which imports three others and a package, and declares
    a symbol for each remainder of the parts it ships."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    p = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), (F.col("l_partkey") % 50).alias("p")).groupBy("s_suppkey").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    other = lambda i: ((F.col("s_suppkey") * 7 + i) % 10 + 1).cast("string")
    imported = [F.concat(F.lit(f"import {{ f{i} as g{i}, helper{i} }} from './"), F.when(F.lit(i == 2), "../lib/").otherwise(""), F.lit("s"), other(i), F.lit("';")) for i in range(3)]
    external = F.concat(F.lit("import pkg from '@scope/pkg"), F.col("s_suppkey") % 5, F.lit("/lib';"))
    declared = lambda x: F.when(x % 2 == 0, F.concat(F.lit("export async function f"), x, F.lit("(a: string) {\n  return g0(a) + new g1('helper0'); // helper1()\n}"))).otherwise(F.concat(F.lit("const c"), x, F.lit(" = 1;")))
    text = F.concat_ws("\n", F.lit("/* import { no } from './s1';"), F.lit("export function no() {} */"), *imported, external, F.transform("ps", declared))
    return s.join(p, "s_suppkey").select(F.concat(F.lit("src/s"), "s_suppkey", F.lit(".ts")).alias("path"), text.alias("source"), F.lit("typescript").alias("language"))


SOURCES = """shipped AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 50 AS p FROM lineitem),
files AS (SELECT DISTINCT s, 'src/s' || s || '.ts' AS path FROM shipped JOIN supplier ON s_suppkey = s),
three AS (SELECT unnest([0, 1, 2]) AS i),
imported AS (SELECT s, path AS module, i, CASE WHEN i = 2 THEN './../lib/s' ELSE './s' END || ((s * 7 + i) % 10 + 1) AS specifier, 'src/s' || ((s * 7 + i) % 10 + 1) || '.ts' AS target FROM files, three)"""


def class_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script files, one for each brand: a class with a method for each size, an enum, an arrow function, a function, a re-export."""
    sizes = read(spark, sf_dir, "part").groupBy(F.replace("p_brand", F.lit("rand#"), F.lit("")).alias("b")).agg(F.array_sort(F.collect_set("p_size")).alias("sizes"))
    method = lambda n: F.concat(F.lit("  size"), n, F.lit("(a: number, b?: string): boolean { return u(a) || this.other"), n, F.lit("(b); } // u(0)"))
    head = [F.lit("import { util as u } from './util';"), F.concat(F.lit("export class "), "b", F.lit(" extends Base {")), F.lit('  private name: string = "n(1)";')]
    tail = [F.lit("}"), F.lit("enum Kind { A, C = 2 }"), F.concat(F.lit("export const make = async (x: number) => new "), "b", F.lit("(x);")), F.lit("export function build(p: string, q, r: Map<string, number>): Promise<void> { u(p); }"), F.lit("export { x as y } from './x';")]
    return sizes.select(F.concat(F.lit("src/"), "b", F.lit(".ts")).alias("path"), F.concat_ws("\n", *head, F.transform("sizes", method), *tail).alias("source"), F.lit("typescript").alias("language"))


CLASSES = """brands AS (SELECT DISTINCT replace(p_brand, 'rand#', '') AS b, p_size AS n FROM part),
methods AS (SELECT b, n, 3 + row_number() OVER (PARTITION BY b ORDER BY n) AS line FROM brands),
classes AS (SELECT b, 'src/' || b || '.ts' AS module, 4 + count(*) AS last FROM brands GROUP BY 1)"""


def rust_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rust files: one for each nation with suppliers, with a struct and a method for each supplier; and shared ones by region."""
    s = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("ks"))
    method = lambda k: F.concat(F.lit("    pub fn supp"), k, F.lit("(&self, x: Part) -> Item { Item::new(x) }"))
    lines = [F.lit("use crate::shared::{Item, other::Thing as Part, r2::*};"), F.concat(F.lit("pub struct N"), "n", F.lit(" { pub id: u32, name: String }")), F.concat(F.lit("impl N"), "n", F.lit(" {")), F.transform("ks", method), F.lit("}"), F.lit("pub enum E { A, B(u32) }")]
    own = s.select(F.concat(F.lit("src/n"), "n", F.lit(".rs")).alias("path"), F.concat_ws("\n", *lines).alias("source"))
    k = F.col("r_regionkey")
    shared = read(spark, sf_dir, "region").select(F.concat(F.lit("src/shared"), F.when(k == 0, ".rs").when(k == 1, "/other.rs").otherwise(F.concat(F.lit("/r"), k, F.lit(".rs")))).alias("path"), F.concat(F.lit("pub struct Shared"), k, F.lit(";")).alias("source"))
    return own.unionByName(shared).withColumn("language", F.lit("rust"))


RUST = """supps AS (SELECT s_nationkey AS n, s_suppkey AS k, 'src/n' || s_nationkey || '.rs' AS module, 3 + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS line FROM supplier),
owners AS (SELECT DISTINCT n, module FROM supps)"""


def scoped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script files, one for each nation, with a line for each customer: names hidden by parameters, patterns and blocks, uses in templates, types
    and classes. They import from two further files."""
    k = F.col("c_custkey").cast("string")
    line = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.concat(F.lit("const v"), k, F.lit(" = `n ${a(B)} `;")))
        .when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("function f"), k, F.lit("(a) { return a(B); }")))
        .when(F.col("c_mktsegment") == "FURNITURE", F.lit("{ let { a, z: [c] } = B; a(c); }"))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit("const w"), k, F.lit(" = (x: c) => a.k;")))
        .otherwise(F.concat(F.lit("class D"), k, F.lit(" extends a { m() { return B[c]; } }")))
    )
    own = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("k"), line.alias("line")))).alias("lines"))
    text = F.concat_ws("\n", F.lit("import { a, c } from './lib';"), F.lit("import B from './b';"), F.transform("lines", lambda x: x["line"]))
    own = own.select(F.concat(F.lit("src/n"), "c_nationkey", F.lit(".ts")).alias("path"), text.alias("source"))
    shared = read(spark, sf_dir, "region").filter("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "src/lib.ts").otherwise("src/b.ts").alias("path"), F.concat(F.lit("export const k = "), "r_regionkey", F.lit(";")).alias("source"))
    return own.unionByName(shared).withColumn("language", F.lit("typescript"))


SCOPED = """scoped AS (SELECT c_mktsegment AS segment, length(c_custkey::VARCHAR) AS l, 'src/n' || c_nationkey || '.ts' AS module, 2 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line FROM customer),
forms(segment, name, col, shifts, kind) AS (VALUES ('AUTOMOBILE', 'a', 15, 1, 'Call'), ('AUTOMOBILE', 'B', 17, 1, 'Call'), ('BUILDING', 'B', 25, 1, 'Call'), ('FURNITURE', 'B', 22, 0, 'Usage'),
  ('HOUSEHOLD', 'c', 14, 1, 'TypeReference'), ('HOUSEHOLD', 'a', 20, 1, 'PropertyAccess'), ('MACHINERY', 'a', 16, 1, 'Extends'), ('MACHINERY', 'B', 33, 1, 'Extends'), ('MACHINERY', 'c', 35, 1, 'Extends')),
scoped_uses AS (SELECT CASE name WHEN 'B' THEN 'src/b.ts:default' ELSE 'src/lib.ts:' || name END AS target_symbol, module || ':' || name AS source_symbol, module AS file, CAST(line AS INTEGER) AS line, CAST(col + shifts * l AS INTEGER) AS col, kind FROM scoped JOIN forms USING (segment))"""


def generated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rust files, one for each nation, with an item for each customer: as its specification asks, or with parameters, types, result, kind or the item
    itself otherwise."""
    k = F.col("c_custkey").cast("string")
    forms = {
        "AUTOMOBILE": ("/// Customer ", k, ".\npub async fn get_cust_", k, "(acc_bal: f64, seg: Vec<String>) -> Result<u32, E> { a(b) }"),
        "BUILDING": ("/* no */\npub async fn get_cust_", k, "(acc_bal: f64) -> Result<u32, E> { a(b) }"),
        "FURNITURE": ("// no\nfn GetCust", k, "(bal: f32, mut seg: Vec<Str>) {}"),
        "HOUSEHOLD": ("// fn get_cust_", k, "() {}\n// no"),
        "MACHINERY": ("#[derive(Debug)]\npub struct GetCust", k, "<T> { a: T, pub b: Map<K, V> }"),
    }
    line = F.lit("")
    for segment, parts in forms.items():
        line = F.when(F.col("c_mktsegment") == segment, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise(line)
    own = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("k"), line.alias("line")))).alias("lines"))
    return own.select(F.concat(F.lit("src/n"), "c_nationkey", F.lit(".rs")).alias("path"), F.concat_ws("\n", F.transform("lines", lambda x: x["line"])).alias("source"), F.lit("rust").alias("language"))


def specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What generated_files are asked to hold: a function for each customer."""
    k = F.col("c_custkey").cast("string")
    params = F.array(F.struct(F.lit("accBal").alias("name"), F.lit("f64").alias("type")), F.struct(F.lit("seg").alias("name"), F.lit("Vec<String>").alias("type")))
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("src/n"), "c_nationkey", F.lit(".rs")).alias("file"), F.col("c_custkey").alias("at"), F.concat(F.lit("getCust"), k).alias("name"), F.concat(F.lit("get_cust_"), k).alias("target_name"),
        F.lit("function").alias("kind"), params.alias("params"), F.lit("Result<u32, E>").alias("return_type"), F.lit(True).alias("is_async"), F.lit(None).cast("string").alias("target_signature"),
    )


GENERATED = """asked AS (SELECT 'src/n' || c_nationkey || '.rs' AS file, c_custkey AS at_, c_custkey::VARCHAR AS k, c_mktsegment AS segment, CAST(2 * row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS line FROM customer),
details(segment, text) AS (VALUES ('BUILDING', 'parameter count: expected 2, got 1'), ('MACHINERY', 'kind mismatch: expected ''function'', got ''struct'''),
  ('FURNITURE', 'param[0] name: expected ''accBal'', got ''bal''; param[0] ''accBal'' type: expected ''f64'', got ''f32''; param[1] ''seg'' type: expected ''Vec<String>'', got ''Vec < Str >''; return type: expected ''Result<u32, E>'', got unit (); async: expected true, got false')),
checked AS (
  SELECT file, at_, 'getCust' || k AS name, segment <> 'HOUSEHOLD' AS found, CASE WHEN segment = 'HOUSEHOLD' THEN 'error' WHEN text IS NOT NULL THEN 'warning' END AS severity,
    CASE WHEN segment = 'HOUSEHOLD' THEN 'Exported symbol ''getCust' || k || ''' (target: ''get_cust_' || k || ''') not found in generated Rust code'
      WHEN text IS NOT NULL THEN 'Symbol ''getCust' || k || ''' (target: ''get_cust_' || k || ''') has structural mismatches: ' || text END AS message,
    CASE WHEN segment = 'HOUSEHOLD' THEN 'function named ''get_cust_' || k || '''' WHEN text IS NOT NULL THEN 'function get_cust_' || k END AS expected,
    CASE WHEN text IS NOT NULL THEN CASE segment WHEN 'MACHINERY' THEN 'struct' ELSE 'function' END || ' at line ' || line END AS actual, CASE WHEN text IS NOT NULL THEN line END AS line_hint
  FROM asked LEFT JOIN details USING (segment))"""


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script files, one for each supplier, whose declarations list several names, patterns among them, and whose default export has none."""
    k = F.col("s_suppkey").cast("string")
    lines = [
        F.concat(F.lit("export const a"), k, F.lit(" = f(1, 2), b"), k, F.lit(" = async (x: number) => x,")), F.concat(F.lit("  c"), k, F.lit(": Map<string, number> = y, { p, q } = z, d;")),
        F.lit("let [r, s] = t;"), F.when(F.col("s_nationkey") % 2 == 0, "export default function (a: string) { const n = 1, m = 2; }").otherwise("export default class extends B { k = 1; }"),
    ]
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("src/s"), k, F.lit(".ts")).alias("path"), F.concat_ws("\n", *lines).alias("source"), F.lit("typescript").alias("language"))


LISTED = """listed AS (SELECT 'src/s' || s_suppkey || '.ts' AS module, s_suppkey::VARCHAR AS k, s_nationkey % 2 = 0 AS even FROM supplier)"""


def moved_files(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """A file for each customer with orders, a line for each order. In the second version those of one segment stand elsewhere, of one elsewhere and
    with lines for a third of their orders written twice, of one elsewhere with all lines changed; those of one are gone."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    segment, line = F.col("c_mktsegment"), F.concat(F.lit("order "), "o_orderkey")
    lines = F.array(line)
    if version:
        o = o.filter("c_mktsegment <> 'HOUSEHOLD'")
        twice = F.when((segment == "BUILDING") & (F.col("o_orderkey") % 3 == 0), F.array(line, F.concat(F.lit("again "), "o_orderkey")))
        lines = twice.when(segment == "MACHINERY", F.array(F.concat(F.lit("other "), "o_orderkey"))).otherwise(lines)
    folder = F.when(segment == "FURNITURE", "old/c").otherwise("new/c" if version else "old/c")
    each = o.select(F.concat(folder, F.col("c_custkey").cast("string")).alias("path"), F.col("o_orderkey").alias("k"), lines.alias("lines"))
    return each.groupBy("path").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "lines"))), lambda x: x["lines"])), "\n").alias("source"))


MOVED = """moved AS (SELECT c_custkey AS k, c_mktsegment AS segment, sum(length('order ' || o_orderkey) + 1) AS shared, sum(CASE WHEN o_orderkey % 3 = 0 THEN length('again ' || o_orderkey) + 1 ELSE 0 END) AS more
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""
