"""The registered queries of the core library, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import levels, naming, texts
from factloom.operators import align, boundaries, compat, diff, extract_facts, graph, reports, rust_items, scoring, tasks, tokens
from factloom.operators.rounds import settled, stored
from factloom.plans import relations as R
from factloom.sources import renames, trees

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


LONGEST = """walk AS (SELECT id, 0 AS d FROM nodes UNION SELECT e.dst, w.d + 1 FROM walk w JOIN edges e ON e.src = w.id),
layers AS (SELECT id, max(d) AS layer FROM walk GROUP BY id)"""


@registered(f"WITH RECURSIVE {R.EDGES} SELECT n.id, (SELECT count(*) FROM all_edges WHERE dst = n.id) AS in_degree, (SELECT count(*) FROM all_edges WHERE src = n.id) AS out_degree FROM nodes n")
def op_a1_degrees(spark, sf_dir):
    return graph.degrees(R.edges(spark, sf_dir))


@registered(f"WITH {R.EDGES} SELECT id FROM nodes")
def op_u4_node_set(spark, sf_dir):
    return graph.node_set(R.edges(spark, sf_dir))


@registered(f"WITH RECURSIVE {R.FLOWS}, f AS (SELECT DISTINCT src, dst FROM flows WHERE src <> dst), reach AS (SELECT src AS a, dst AS b FROM f UNION SELECT r.a, f.dst FROM reach r JOIN f ON f.src = r.b), nodes AS (SELECT src AS id FROM flows UNION SELECT dst FROM flows) SELECT n.id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, split_part(n.id, '/', 1) AS top_dir, regexp_extract(n.id, '^(.*)/[^/]*$', 1) AS dir_path, c.a IS NOT NULL AS in_cycle FROM nodes n LEFT JOIN (SELECT dst, count(*) AS n FROM flows GROUP BY 1) i ON i.dst = n.id LEFT JOIN (SELECT src, count(*) AS n FROM flows GROUP BY 1) o ON o.src = n.id LEFT JOIN (SELECT a FROM reach WHERE a = b) c ON c.a = n.id")
def op_g1_build_graph(spark, sf_dir):
    e = stored(R.flows(spark, sf_dir), "flows")
    return graph.build_graph(e, None, graph.cyclic_components(e))


@registered(f"WITH {R.EDGES} SELECT dst AS id, src AS importer FROM edges")
def op_a21_reverse_dependencies(spark, sf_dir):
    return graph.importers(R.edges(spark, sf_dir))


@registered(f"WITH {R.FLOWS} SELECT DISTINCT src AS id FROM flows WHERE src = dst")
def op_g2_self_loops(spark, sf_dir):
    return graph.self_loops(R.flows(spark, sf_dir))


@registered(f"WITH RECURSIVE {R.FLOWS}, f AS (SELECT DISTINCT src, dst FROM flows WHERE src <> dst), reach AS (SELECT src AS a, dst AS b FROM f UNION SELECT r.a, f.dst FROM reach r JOIN f ON f.src = r.b) SELECT r.a AS id, least(r.a, min(r.b)) AS component FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a WHERE r.a <> r.b GROUP BY r.a")
def op_g4_cyclic_components(spark, sf_dir):
    return graph.cyclic_components(R.flows(spark, sf_dir))


@registered(f"""WITH RECURSIVE {R.FLOWS}, f AS (SELECT DISTINCT src, dst FROM flows WHERE src <> dst), reach AS (SELECT src AS a, dst AS b FROM f UNION SELECT r.a, f.dst FROM reach r JOIN f ON f.src = r.b),
members AS (SELECT r.a AS id, least(r.a, min(r.b)) AS component FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a WHERE r.a <> r.b GROUP BY r.a),
inside AS (SELECT m.component, src, dst FROM f JOIN members m ON m.id = src JOIN members n ON n.id = dst AND n.component = m.component),
walk AS (SELECT component, dst AS id, 1 AS d FROM inside WHERE src = component UNION SELECT w.component, i.dst, w.d + 1 FROM walk w JOIN inside i ON i.component = w.component AND i.src = w.id WHERE w.id <> w.component AND w.d < (SELECT count(*) FROM members))
SELECT component, component AS first, component AS last, min(d) AS links FROM walk WHERE id = component GROUP BY component""")
def op_g3_witness_cycles(spark, sf_dir):
    e = R.flows(spark, sf_dir)
    found = graph.witness_cycles(e, graph.cyclic_components(e))
    return found.groupBy("component").agg(F.min_by("id", "place").alias("first"), F.max_by("id", "place").alias("last"), (F.max("place") - 1).alias("links"))


@registered(f"WITH RECURSIVE {R.EDGES}, {LONGEST} SELECT id, CAST(layer AS BIGINT) AS layer FROM layers")
def op_g5_layers_topdown(spark, sf_dir):
    e = R.edges(spark, sf_dir)
    return graph.layers_topdown(e)


@registered(f"WITH RECURSIVE {R.EDGES}, {LONGEST} SELECT id, CAST((SELECT max(layer) FROM layers) - layer AS BIGINT) AS layer FROM layers")
def op_g6_layers_bottomup(spark, sf_dir):
    e = R.edges(spark, sf_dir)
    return graph.layers_bottomup(e)


@registered(f"WITH RECURSIVE {R.EDGES}, bfs AS (SELECT 'region/1' AS id, 0 AS depth UNION SELECT e.src, b.depth + 1 FROM bfs b JOIN edges e ON e.dst = b.id), least AS (SELECT id, min(depth) AS depth FROM bfs GROUP BY 1) SELECT l.id, CAST(l.depth AS BIGINT) AS depth, (SELECT min(e.dst) FROM edges e JOIN least p ON p.id = e.dst AND p.depth = l.depth - 1 WHERE e.src = l.id) AS via FROM least l")
def op_g7_impact(spark, sf_dir):
    e = R.edges(spark, sf_dir)
    return graph.impact(e.select(F.col("dst").alias("target"), F.col("src").alias("source")), e.filter("dst = 'region/1'").select(F.col("dst").alias("id")).distinct())


IMPACT = f"""WITH RECURSIVE {R.EDGES}, refs AS (SELECT dst || ':n' AS target_symbol, src || ':n' AS symbol, CASE WHEN length(src) % 2 = 0 THEN 'Call' ELSE 'Usage' END AS kind FROM edges),
bfs AS (SELECT 'region/1:n' AS id, 0 AS depth UNION SELECT r.symbol, b.depth + 1 FROM bfs b JOIN refs r ON r.target_symbol = b.id), least AS (SELECT id, min(depth) AS depth FROM bfs GROUP BY 1),
links AS (SELECT min({{'f': r.target_symbol, 'k': r.kind}}) AS v, l.id AS to_symbol, l.depth FROM least l JOIN refs r ON r.symbol = l.id JOIN least p ON p.id = r.target_symbol AND p.depth = l.depth - 1 GROUP BY l.id, l.depth)"""


def _links(spark, sf_dir):
    e = R.edges(spark, sf_dir)
    kind = F.when(F.length("src") % 2 == 0, "Call").otherwise("Usage")
    refs = e.select(F.concat("dst", F.lit(":n")).alias("target_symbol"), F.concat("src", F.lit(":n")).alias("source_symbol"), kind.alias("kind"), F.col("src").alias("file"))
    seeds = R.read(spark, sf_dir, "region").filter("r_regionkey = 1").select(F.lit("region/1:n").alias("symbol"))
    return graph.impact_links(refs, seeds), seeds


@registered(f"{IMPACT} SELECT v.f AS from_symbol, to_symbol, v.k AS kind, CAST(depth AS BIGINT) AS depth FROM links")
def op_g7_impact_links(spark, sf_dir):
    return _links(spark, sf_dir)[0].drop("file")


@registered(f"{IMPACT}, files AS (SELECT DISTINCT split_part(to_symbol, ':', 1) AS file FROM links UNION SELECT 'region/1') SELECT file, CAST(row_number() OVER (ORDER BY file) AS INTEGER) AS place FROM files")
def op_g7_affected_files(spark, sf_dir):
    return graph.affected_files(*_links(spark, sf_dir))


@registered(f"WITH RECURSIVE {R.EDGES}, {LONGEST}, deg AS (SELECT dst AS id, count(*) AS n FROM edges GROUP BY 1), m AS (SELECT l.id, (SELECT max(layer) FROM layers) - l.layer AS layer, coalesce(d.n, 0) AS n FROM layers l LEFT JOIN deg d USING (id)) SELECT CAST(layer AS BIGINT) AS layer, count(*) AS n_modules, CAST(sum(n) AS BIGINT) AS public_symbols, CASE layer WHEN 0 THEN 'Foundation: zero external dependencies, migrate first' WHEN 1 THEN 'Core logic: depends on foundation only' WHEN 2 THEN 'Feature modules: core + cross-cutting' ELSE 'Higher-level composition' END AS label FROM m GROUP BY layer")
def op_a20_layer_groups(spark, sf_dir):
    e = R.edges(spark, sf_dir)
    used = e.distinct().groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    modules = graph.layers_bottomup(e).join(used.hint("shuffle_hash"), "id", "left")
    return boundaries.layer_groups(modules.select(F.col("id").alias("module"), "layer", F.coalesce("n", F.lit(0).cast("long")).alias("public_symbols")))


@registered(f"WITH RECURSIVE {R.EDGES}, {LONGEST}, up AS (SELECT id, (SELECT max(layer) FROM layers) - layer AS layer FROM layers), refs AS (SELECT 'order/' || l_orderkey AS consumer, 'supp/' || l_suppkey AS provider, 'part/' || (l_partkey % 50) AS symbol, l_returnflag AS kind FROM lineitem UNION ALL SELECT 'nation/' || n_nationkey, 'order/' || n_nationkey, n_name, 'X' FROM nation) SELECT r.consumer, r.provider, r.symbol, CAST(coalesce(c.layer, 0) AS BIGINT) AS consumer_layer, CAST(coalesce(p.layer, 0) AS BIGINT) AS provider_layer, min(r.kind) AS kind, 'L' || coalesce(c.layer, 0) || '->L' || coalesce(p.layer, 0) AS direction FROM refs r LEFT JOIN up c ON c.id = r.consumer LEFT JOIN up p ON p.id = r.provider WHERE coalesce(c.layer, 0) > coalesce(p.layer, 0) GROUP BY 1, 2, 3, 4, 5, 7")
def op_j22_uncut_surfaces(spark, sf_dir):
    e = R.edges(spark, sf_dir)
    li, n = R.read(spark, sf_dir, "lineitem"), R.read(spark, sf_dir, "nation")
    refs = li.select(F.concat(F.lit("order/"), "l_orderkey").alias("consumer"), F.concat(F.lit("supp/"), "l_suppkey").alias("provider"), F.concat(F.lit("part/"), F.col("l_partkey") % 50).alias("symbol"), F.col("l_returnflag").alias("kind"))
    refs = refs.unionByName(n.select(F.concat(F.lit("nation/"), "n_nationkey").alias("consumer"), F.concat(F.lit("order/"), "n_nationkey").alias("provider"), F.col("n_name").alias("symbol"), F.lit("X").alias("kind")))
    return boundaries.uncut(refs, graph.layers_bottomup(e))


@registered("WITH e AS (SELECT p_brand AS module, p_partkey || '/' || q AS symbol FROM part, range(1, 51) r(q)), u AS (SELECT DISTINCT p_brand AS module, p_partkey || '/' || CAST(l_quantity AS INTEGER) AS symbol FROM lineitem JOIN part ON p_partkey = l_partkey WHERE 'Brand#' || l_suppkey <> p_brand) SELECT e.*, u.symbol IS NOT NULL AS is_public FROM e LEFT JOIN u USING (module, symbol)")
def op_j21_external_usage(spark, sf_dir):
    """A symbol for each part and quantity, which lines of that quantity use."""
    p = R.read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("module"))
    exports = p.select("module", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("q"), "p_partkey").select("module", F.concat_ws("/", "p_partkey", "q").alias("symbol"))
    refs = R.read(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select("module", F.concat_ws("/", "p_partkey", F.col("l_quantity").cast("int")).alias("symbol"), F.concat(F.lit("Brand#"), "l_suppkey").alias("file"))
    return boundaries.external_usage(exports, refs)


@registered("SELECT p_brand AS module, count(*) AS in_degree FROM (SELECT DISTINCT p_brand, p_partkey, l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1")
def op_a2_reference_degree(spark, sf_dir):
    return scoring.reference_degree(_refs(spark, sf_dir))


def _refs(spark, sf_dir):
    li = R.read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    p = R.read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("module"), F.col("p_partkey").alias("symbol"), F.col("l_orderkey").alias("file"))


@registered("SELECT CAST(doc_id AS VARCHAR) AS module, round(len(string_split(text, chr(10))) * ln(greatest(len(string_split(text, chr(10))), 1)) * 100) / 100 AS complexity FROM documents")
def op_a3_complexity(spark, sf_dir):
    lines = R.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("module"), F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    return scoring.complexity(lines.select("module", "ordinal", (F.col("ordinal") + 1).alias("line_end"))).withColumn("complexity", levels.round2(F.col("complexity")))


MODULE_COMPAT = """lv AS (SELECT 'supp/' || s_suppkey AS package, CASE s_suppkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 ELSE 0.3 END AS s FROM supplier WHERE s_acctbal > 1000),
md AS (SELECT DISTINCT 'order/' || l_orderkey AS module, 'supp/' || l_suppkey AS package FROM lineitem),
ms AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'test/' ELSE '' END || 'order/' || o_orderkey AS module FROM orders),
mc AS (SELECT ms.module, CASE WHEN k.n IS NULL THEN CASE WHEN regexp_matches(lower(ms.module), 'test|spec') THEN least((SELECT avg(s) FROM lv) + 0.15, 1.0) ELSE (SELECT avg(s) FROM lv) END ELSE coalesce(least(greatest(k.mean, 0.0), 1.0), (SELECT avg(s) FROM lv)) END AS c FROM ms LEFT JOIN (SELECT md.module, count(*) AS n, avg(s) AS mean FROM md LEFT JOIN lv USING (package) GROUP BY 1) k USING (module))"""


@registered(f"WITH {MODULE_COMPAT} SELECT module, round(c * 1000000) / 1000000 AS external_compatibility FROM mc")
def op_a6_module_compatibility(spark, sf_dir):
    """Six places: with two, halves of a hundredth would fall either way by the order in which a mean is summed."""
    return _module_compat(spark, sf_dir).withColumn("external_compatibility", F.round(F.col("external_compatibility") * 1000000) / 1000000)


def _module_compat(spark, sf_dir):
    s = R.read(spark, sf_dir, "supplier").filter("s_acctbal > 1000")
    compat_ = s.select(F.concat(F.lit("supp/"), "s_suppkey").alias("package"), R.level(F.col("s_suppkey")).alias("level"))
    deps = R.read(spark, sf_dir, "lineitem").select(F.concat(F.lit("order/"), "l_orderkey").alias("module"), F.concat(F.lit("supp/"), "l_suppkey").alias("package"))
    modules = R.read(spark, sf_dir, "orders").select(F.concat(F.when(F.col("o_orderpriority") == "5-LOW", "test/").otherwise(""), F.lit("order/"), "o_orderkey").alias("module"))
    return scoring.module_compatibility(modules, deps, compat_)


@registered("""WITH d AS (SELECT p_brand AS module, count(*) AS n FROM (SELECT DISTINCT p_brand, p_partkey, l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1),
c AS (SELECT p_brand AS module, count(*) * ln(greatest(max_by(p_size, p_partkey), 1)) AS c FROM part WHERE p_size > 3 GROUP BY 1),
lv AS (SELECT p_type AS package, CASE length(p_type) % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 ELSE 0.3 END AS s FROM (SELECT DISTINCT p_type FROM part)),
e AS (SELECT p_brand AS module, avg(s) AS s FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size < 4) JOIN lv ON package = p_type GROUP BY 1),
y AS (SELECT p_brand AS module, count(*) AS n FROM (SELECT DISTINCT p_size, p_brand FROM part WHERE p_size > 45 AND p_retailprice > 950) GROUP BY 1),
t AS (SELECT DISTINCT p_brand AS module FROM part WHERE p_name LIKE 'small%' AND p_size = 7),
f AS (SELECT m.module, coalesce(d.n, 0) AS i, coalesce(c.c, 1.0) AS c, coalesce(e.s, (SELECT avg(s) FROM lv)) AS e, coalesce(y.n, 0) AS y, t.module IS NOT NULL AS has_tests FROM (SELECT DISTINCT p_brand AS module FROM part) m LEFT JOIN d USING (module) LEFT JOIN c USING (module) LEFT JOIN e USING (module) LEFT JOIN y USING (module) LEFT JOIN t ON t.module = m.module),
p AS (SELECT *, 30.0 * i / (SELECT greatest(max(i), 1) FROM f) AS p1, 25.0 * greatest(0.0, 1 - c / (SELECT greatest(max(c), 1) FROM f)) AS p2, 20.0 * e AS p3, 15.0 * greatest(0.0, 1 - y / (SELECT greatest(max(y), 1) FROM f)) AS p4, CASE WHEN has_tests THEN 10.0 ELSE 0.0 END AS p5 FROM f),
r AS (SELECT *, p1::DOUBLE + p2 + p3 + p4 + p5 AS raw FROM p),
s AS (SELECT module, round(raw * 100) / 100 AS score, CASE WHEN raw >= 70 THEN 'trivial' WHEN raw >= 50 THEN 'moderate' WHEN raw >= 30 THEN 'heavy' ELSE 'rewrite' END AS migration_effort, i AS in_degree, round(c * 100) / 100 AS complexity, round(e * 100) / 100 AS external_compatibility, y AS cycle_count, has_tests, round(p1::DOUBLE * 100) / 100 AS part_in_degree, round(p2 * 100) / 100 AS part_complexity, round(p3 * 100) / 100 AS part_compatibility, round(p4 * 100) / 100 AS part_cycles, CAST(p5 AS DOUBLE) AS part_tests FROM r)
SELECT *, CAST(row_number() OVER (ORDER BY score DESC, module) AS INTEGER) AS rank FROM s""")
def op_a8_readiness(spark, sf_dir):
    """Flagship: brands as modules, parts as symbols, orders as the files that use them."""
    part = R.read(spark, sf_dir, "part")
    modules = part.select(F.col("p_brand").alias("module")).distinct()
    complex_ = scoring.complexity(part.filter("p_size > 3").select(F.col("p_brand").alias("module"), F.col("p_partkey").alias("ordinal"), F.col("p_size").alias("line_end")))
    types = part.select(F.col("p_type").alias("package")).distinct()
    levels_ = types.select("package", R.level(F.length("package")).alias("level"))
    deps = part.filter("p_size < 4").select(F.col("p_brand").alias("module"), F.col("p_type").alias("package"))
    cycles = part.filter("p_size > 45 and p_retailprice > 950").groupBy("p_size").agg(F.collect_set("p_brand").alias("members"))
    tests = part.filter("p_name like 'small%' and p_size = 7").select(F.col("p_brand").alias("module"))
    return scoring.readiness(modules, scoring.reference_degree(_refs(spark, sf_dir)), complex_, scoring.module_compatibility(modules, deps, levels_), scoring.cycle_counts(cycles), tests)


@registered(f"""WITH {R.LIBRARIES}, a AS (SELECT * FROM libs WHERE side = 0), b AS (SELECT * FROM libs WHERE side = 1),
ta AS (SELECT name, lib_type, len(tags) AS n, unnest(tags) AS tag FROM a), tb AS (SELECT name, lib_type, len(tags) AS n, unnest(tags) AS tag FROM b),
m AS (SELECT ta.name AS a, tb.name AS b, 0.8::DOUBLE * (count(*)::DOUBLE / (ta.n + tb.n - count(*))) + CASE WHEN ta.lib_type = tb.lib_type THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS s FROM ta JOIN tb USING (tag) GROUP BY ta.name, tb.name, ta.n, tb.n, ta.lib_type, tb.lib_type
 UNION ALL SELECT a.name, t.b, 0.2::DOUBLE FROM a JOIN (SELECT lib_type, min(name) AS b FROM b GROUP BY 1) t USING (lib_type)),
w AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM m)
SELECT a.name, w.b AS equivalent, round(coalesce(w.s, 0.0::DOUBLE) * 10000) / 10000 AS similarity, CASE WHEN coalesce(w.s, 0) >= 0.5 THEN 'full' WHEN w.s >= 0.25 THEN 'partial' WHEN w.s > 0 THEN 'none' ELSE 'unknown' END AS level FROM a LEFT JOIN w ON w.a = a.name AND w.k = 1""")
def op_j7_best_matches(spark, sf_dir):
    out = compat.best_matches(R.libraries(spark, sf_dir, 0), R.libraries(spark, sf_dir, 1))
    return out.withColumn("similarity", F.round(F.col("similarity") * 10000) / 10000)


@registered("""WITH l AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ') || [p_brand]) AS tags, p_type FROM part),
p AS (SELECT a.p_partkey AS part, len(list_intersect(a.tags, b.tags)) AS i, len(list_distinct(a.tags || b.tags)) AS u, a.p_type = b.p_type AS t FROM l a JOIN l b ON b.p_partkey = a.p_partkey + 1)
SELECT part, round(i::DOUBLE / u * 10000) / 10000 AS jaccard, round((0.8::DOUBLE * (i::DOUBLE / u) + CASE WHEN t THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) * 10000) / 10000 AS similarity FROM p""")
def op_a10_similarity(spark, sf_dir):
    p = R.read(spark, sf_dir, "part").select("p_partkey", F.concat(F.split("p_name", " "), F.array("p_brand")).alias("tags"), "p_type")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("tags").alias("other"), F.col("p_type").alias("other_type"))
    out = p.join(q, "p_partkey").select(F.col("p_partkey").alias("part"), compat.jaccard(F.col("tags"), F.col("other")).alias("jaccard"), compat.similarity(F.col("tags"), F.col("other"), F.col("p_type") == F.col("other_type")).alias("similarity"))
    return out.select("part", *[(F.round(F.col(c) * 10000) / 10000).alias(c) for c in ("jaccard", "similarity")])


EVALUATED = """lvl AS (SELECT 'supp/' || s_suppkey AS package, s_acctbal > 8000 OR s_nationkey < 12 AS mapped, CASE WHEN s_acctbal > 8000 THEN 'over' WHEN s_nationkey < 12 THEN 'nat' || s_nationkey END AS equivalent,
  CASE WHEN s_acctbal > 8000 THEN ['full','partial','none','unknown'][1 + s_suppkey % 4] WHEN s_nationkey < 12 THEN ['full','partial','none','unknown'][1 + s_nationkey % 4] ELSE 'unknown' END AS level FROM supplier),
ev AS (SELECT *, CASE level WHEN 'full' THEN 'trivial' WHEN 'partial' THEN 'moderate' WHEN 'none' THEN 'rewrite' ELSE 'unknown' END AS effort FROM lvl),
pm AS (SELECT 'supp/' || l_suppkey AS package, count(*) AS affected FROM (SELECT l_suppkey, l_partkey FROM lineitem GROUP BY ALL HAVING count(*) > 2) GROUP BY 1)"""


def _evaluated(spark, sf_dir):
    s = R.read(spark, sf_dir, "supplier").withColumn("package", F.concat(F.lit("supp/"), "s_suppkey"))
    extra = [F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("guidance")]
    over = s.filter("s_acctbal > 8000").select("package", F.lit("over").alias("equivalent"), R.level(F.col("s_suppkey")).alias("level"), *extra)
    built = s.filter("s_nationkey < 12").select("package", F.concat(F.lit("nat"), "s_nationkey").alias("equivalent"), R.level(F.col("s_nationkey")).alias("level"), *extra)
    return compat.evaluated(s, over, built)


def _package_modules(spark, sf_dir):
    """Parts are the modules of the suppliers that ship them three times or more."""
    li = R.read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").count().filter("count > 2")
    return compat.package_modules(li.select(F.concat(F.lit("supp/"), "l_suppkey").alias("package"), F.col("l_partkey").cast("string").alias("module")))


@registered(f"WITH {EVALUATED} SELECT package, equivalent, level, effort, CASE WHEN NOT mapped THEN 'unmapped' WHEN level = 'none' THEN 'rewrite,no-equivalent' WHEN level = 'unknown' THEN 'unverified' ELSE '' END AS risk_tags FROM ev")
def op_j8_evaluate_packages(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("package", "equivalent", "level", "effort", F.array_join("risk_tags", ",").alias("risk_tags"))


@registered(f"WITH {EVALUATED} SELECT package, affected FROM pm")
def op_j11_package_modules(spark, sf_dir):
    return _package_modules(spark, sf_dir).select("package", "affected")


@registered(f"WITH {EVALUATED} SELECT ev.package, ev.level, ev.effort, coalesce(pm.affected, 0) AS affected, coalesce(pm.affected, 0) > 5 AND ev.level IN ('unknown', 'none') AS high_impact FROM ev LEFT JOIN pm USING (package)")
def op_t4_recommendations(spark, sf_dir):
    return compat.recommendations(_evaluated(spark, sf_dir), _package_modules(spark, sf_dir)).select("package", "level", "effort", "affected", "high_impact")


@registered(f"WITH {EVALUATED} SELECT count(*) AS total, count(*) FILTER (WHERE NOT mapped) AS unmapped, count(*) FILTER (WHERE effort IN ('heavy', 'rewrite')) AS heavy FROM ev")
def op_a17_recommendation_counts(spark, sf_dir):
    return compat.recommendation_counts(_evaluated(spark, sf_dir))


CHANGES = f"""{R.PACKAGES}, ch AS (SELECT package, po.version AS old_version, pn.version AS new_version, CASE WHEN po.version IS NULL THEN 'added' WHEN pn.version IS NULL THEN 'removed' WHEN (pn.major, pn.minor) > (po.major, po.minor) THEN 'upgraded' WHEN (pn.major, pn.minor) < (po.major, po.minor) THEN 'downgraded' ELSE 'patch' END AS change_type FROM po FULL JOIN pn USING (package) WHERE po.version IS DISTINCT FROM pn.version)"""


def _changes(spark, sf_dir):
    return compat.dependency_changes(R.packages(spark, sf_dir, 0), R.packages(spark, sf_dir, 1))


@registered(f"WITH {CHANGES} SELECT * FROM ch")
def op_j9_dependency_changes(spark, sf_dir):
    return _changes(spark, sf_dir)


@registered(f"WITH {CHANGES}, {EVALUATED}, x AS (SELECT ch.*, coalesce(ev.level, 'unknown') AS level FROM ch LEFT JOIN ev USING (package)) SELECT *, CASE change_type WHEN 'added' THEN level IN ('unknown', 'none') WHEN 'removed' THEN level IN ('full', 'partial') ELSE level IN ('partial', 'unknown') END AS needs_review FROM x")
def op_d15_reviewed_changes(spark, sf_dir):
    return compat.reviewed(_changes(spark, sf_dir), _evaluated(spark, sf_dir))


@registered(f"WITH {CHANGES}, {EVALUATED} SELECT ch.package, ch.change_type, coalesce(pm.affected, 0) AS affected, coalesce(pm.affected, 0) > 5 AND coalesce(ev.level, 'unknown') IN ('unknown', 'none') AS high_risk FROM ch LEFT JOIN ev USING (package) LEFT JOIN pm USING (package)")
def op_j25_change_impact(spark, sf_dir):
    return compat.change_impact(compat.reviewed(_changes(spark, sf_dir), _evaluated(spark, sf_dir)), _package_modules(spark, sf_dir)).select("package", "change_type", "affected", "high_risk")


def _fields(x: str) -> str:
    return f"{x}.n AS {x}_n, {x}.kinds AS {x}_k, {x}.return_type AS {x}_r, {x}.price AS {x}_p, {x}.kind AS {x}_kind, {x}.ordinal AS {x}_o"


MAPPING = f"""{R.SYMBOLS},
st AS (SELECT module, name FROM old INTERSECT SELECT module, name FROM new),
rm AS (SELECT * FROM old WHERE (module, name) NOT IN (SELECT module, name FROM st)), ad AS (SELECT * FROM new WHERE (module, name) NOT IN (SELECT module, name FROM st))"""


@registered(f"WITH {MAPPING} SELECT module, name, 'stable' AS status FROM st UNION ALL SELECT module, name, 'removed' FROM rm UNION ALL SELECT module, name, 'added' FROM ad")
def op_j13_symbol_versions(spark, sf_dir):
    """By name alone: a rename threshold that nothing reaches."""
    old, new = R.symbols(spark, sf_dir, 0), R.symbols(spark, sf_dir, 1)
    both = diff.set_changes(old, new, ["module", "name"]).select("module", "name", F.col("change_type").alias("status"))
    stable = old.select("module", "name").join(new.select("module", "name"), ["module", "name"], "left_semi").distinct()
    return both.unionByName(stable.withColumn("status", F.lit("stable")))


@registered(None)
def op_d3_symbol_mapping(spark, sf_dir):
    """With renames; the longest common subsequence is tested against brute force."""
    return diff.symbol_mapping(R.symbols(spark, sf_dir, 0), R.symbols(spark, sf_dir, 1))


@registered(None)
def op_d11_symbol_changes(spark, sf_dir):
    return diff.symbol_changes(R.symbols(spark, sf_dir, 0), R.symbols(spark, sf_dir, 1))


@registered(f"WITH {R.SYMBOLS}, j AS (SELECT o.module, o.name, o.return_type AS a, n.return_type AS b, o.n > 1 AS x, n.n > 1 AS y FROM old o JOIN new n USING (module, name)) SELECT module, name, 'return_type' AS aspect, 'breaking' AS severity, coalesce(a, '') || '->' || coalesce(b, '') AS detail FROM j WHERE a IS DISTINCT FROM b UNION ALL SELECT module, name, 'async', 'breaking', x::VARCHAR || '->' || y::VARCHAR FROM j WHERE x <> y")
def op_d5_return_and_async(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    every = F.concat(diff.flag_change("return_type", "breaking", F.col("o.return_type"), F.col("n.return_type")), diff.flag_change("async", "breaking", F.col("o.is_async"), F.col("n.is_async")))
    return pairs.select("module", "name", F.explode(every).alias("c")).select("module", "name", "c.*")


def _pairs(spark, sf_dir):
    side = lambda v, x: R.symbols(spark, sf_dir, v).select("module", "name", F.struct("*").alias(x))
    return side(0, "o").join(side(1, "n"), ["module", "name"])


@registered(f"WITH {R.SYMBOLS}, j AS (SELECT o.module, o.name, o.kinds AS a, n.kinds AS b FROM old o JOIN new n USING (module, name)), u AS (SELECT module, name, a, b, unnest(list_distinct(a || b)) AS k FROM j) SELECT module, name, CASE k WHEN 'F' THEN 'method' ELSE 'property' END AS aspect, CASE WHEN list_contains(a, k) THEN 'breaking' ELSE 'compatible' END AS severity, CASE WHEN list_contains(a, k) THEN '-' ELSE '+' END || k AS detail FROM u WHERE list_contains(a, k) <> list_contains(b, k)")
def op_d6_child_changes(spark, sf_dir):
    return _pairs(spark, sf_dir).select("module", "name", F.explode(diff.child_changes(F.col("o.children"), F.col("n.children"))).alias("c")).select("module", "name", "c.*")


@registered(f"WITH {R.SYMBOLS}, j AS (SELECT o.module, o.name, o.n AS a, n.n AS b FROM old o JOIN new n USING (module, name)) SELECT module, name, CASE WHEN a = 1 THEN 'added' WHEN b = 1 THEN 'removed' ELSE 'changed' END AS change FROM j WHERE (a > 1 OR b > 1) AND (a = 1 OR b = 1 OR a <> b)")
def op_d8_doc_changes(spark, sf_dir):
    return _pairs(spark, sf_dir).select("module", "name", diff.doc_change(F.col("o.doc"), F.col("n.doc")).alias("change")).filter("change is not null")


@registered(f"""WITH {R.SYMBOLS}, noted AS (SELECT o.module, o.name, o.n AS a, n.n AS b, o.return_type = 'P' AS da, n.return_type = 'P' AS db FROM old o JOIN new n USING (module, name)),
texts AS (SELECT *, CASE WHEN a > 1 THEN 'doc ' || a || CASE WHEN a % 3 = 0 THEN ' TODO' ELSE '' END || CASE WHEN a % 2 = 0 THEN ' SAFETY' ELSE '' END END AS old_doc, CASE WHEN b > 1 THEN 'doc ' || b || CASE WHEN b % 3 = 0 THEN ' TODO' ELSE '' END || CASE WHEN b % 2 = 0 THEN ' SAFETY' ELSE '' END END AS new_doc FROM noted)
SELECT module, name, CASE WHEN old_doc IS NULL AND new_doc IS NOT NULL THEN 'added' WHEN old_doc IS NOT NULL AND new_doc IS NULL THEN 'removed' ELSE 'changed' END AS change, db AS is_deprecated, b > 1 AND b % 3 = 0 AS has_todo, b > 1 AND b % 2 = 0 AS has_safety_note, old_doc, new_doc FROM texts WHERE old_doc IS DISTINCT FROM new_doc OR da <> db""")
def op_d8_doc_notes(spark, sf_dir):
    n = lambda s: F.col(f"{s}.line_end")
    doc = lambda s: F.when(n(s) > 1, F.concat(F.lit("doc "), n(s), F.when(n(s) % 3 == 0, " TODO").otherwise(""), F.when(n(s) % 2 == 0, " SAFETY").otherwise("")))
    side = lambda s: F.struct(doc(s).alias("doc"), F.when(F.col(f"{s}.return_type") == "P", F.array(F.lit("@deprecated"))).alias("attributes")).alias(s)
    return diff.doc_changes(_pairs(spark, sf_dir).select("module", "name", side("o"), side("n")))


@registered("WITH o AS (SELECT DISTINCT url_host AS m, spec AS s FROM (SELECT split_part(url, '/', 3) AS url_host, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS spec, length(html) AS n FROM pages) WHERE n < 6000), n AS (SELECT DISTINCT url_host AS m, spec AS s FROM (SELECT split_part(url, '/', 3) AS url_host, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS spec, length(html) AS n FROM pages) WHERE n > 2000) SELECT m AS module, s AS specifier, 'removed' AS change_type FROM o WHERE (m, s) NOT IN (SELECT m, s FROM n) UNION ALL SELECT m, s, 'added' FROM n WHERE (m, s) NOT IN (SELECT m, s FROM o)")
def op_d10_import_changes(spark, sf_dir):
    links = R.read(spark, sf_dir, "pages").select(F.split("url", "/")[2].alias("module"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("specifier"), F.length("html").alias("n"))
    return diff.set_changes(links.filter("n < 6000"), links.filter("n > 2000"), ["module", "specifier"])


@registered("SELECT split_part(url, '/', 3) AS module, specifier, NOT regexp_matches(specifier, '^[./]') AS is_external FROM (SELECT DISTINCT url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS specifier FROM pages) GROUP BY ALL")
def op_p7_import_classes(spark, sf_dir):
    links = R.read(spark, sf_dir, "pages").select(F.split("url", "/")[2].alias("module"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("specifier"))
    return links.distinct().withColumn("is_external", ~F.col("specifier").rlike("^[./]"))


@registered("WITH v AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) SELECT conv_id || '/' || turn AS path, CASE WHEN text = next THEN 'unchanged' WHEN next IS NULL THEN 'removed' ELSE 'modified' END AS status, len(string_split(text, chr(10))) AS old_lines, CASE WHEN next IS NULL THEN 0 ELSE len(string_split(next, chr(10))) END AS new_lines FROM v UNION ALL SELECT conv_id || '/' || (turn - 1), 'added', 0, len(string_split(text, chr(10))) FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)")
def op_j15_file_versions(spark, sf_dir):
    c = R.read(spark, sf_dir, "conversations")
    path = lambda turn: F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string"))
    return diff.file_changes(c.select(path(F.col("turn")).alias("path"), F.col("text").alias("source")), c.select(path(F.col("turn") - 1).alias("path"), F.col("text").alias("source")))


@registered(f"WITH {R.TASKS}, s AS (SELECT t.module, t.layer, t.in_degree, CASE WHEN bool_or(e.status = 'verified') THEN 'verified' ELSE max_by(e.status, e.at) END AS status, count(*) FILTER (WHERE e.status = 'in_progress') AS attempts FROM tasks t JOIN task_events e USING (module) GROUP BY 1, 2, 3) SELECT module, layer, in_degree, status, attempts FROM s")
def op_k4_task_states(spark, sf_dir):
    return _states(spark, sf_dir)


def _states(spark, sf_dir):
    pending = R.tasks(spark, sf_dir).withColumn("status", F.lit("pending"))
    return tasks.folded(pending, R.task_events(spark, sf_dir)).select("module", "layer", "in_degree", "status", "attempts")


@registered(f"WITH {R.TASKS}, s AS (SELECT t.module, CASE WHEN bool_or(e.status = 'verified') THEN 'verified' ELSE max_by(e.status, e.at) END AS status FROM tasks t JOIN task_events e USING (module) GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'in_progress') AS in_progress, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status IN ('verified', 'failed')) * 100.0::DOUBLE / count(*) AS percent, count(*) FILTER (WHERE status = 'verified') * 100.0::DOUBLE / count(*) AS manifest_percent FROM s")
def op_a18_progress(spark, sf_dir):
    return tasks.progress(_states(spark, sf_dir))


@registered(f"WITH {R.TASKS} SELECT *, CAST(row_number() OVER (ORDER BY layer, in_degree DESC, module) AS INTEGER) AS task, 'pending' AS status FROM tasks")
def op_k3_task_queue(spark, sf_dir):
    return tasks.queue(R.tasks(spark, sf_dir))


@registered(f"WITH {R.TASKS} SELECT module, layer, in_degree, 'pending' AS status FROM tasks ORDER BY layer, in_degree DESC, module LIMIT 1")
def op_t2_next_task(spark, sf_dir):
    return tasks.next_task(R.tasks(spark, sf_dir).withColumn("status", F.lit("pending")))


@registered("SELECT c_custkey, c_name, lower(regexp_replace(regexp_replace(c_mktsegment || 'Parser' || c_name, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([^_A-Z])([A-Z])', '\\1_\\2', 'g')) AS snake, lower(replace(c_name || '_X', '_', '')) AS loose FROM customer")
def op_f4_snake_case(spark, sf_dir):
    return R.read(spark, sf_dir, "customer").select("c_custkey", "c_name", naming.snake_case(F.concat("c_mktsegment", F.lit("Parser"), "c_name")).alias("snake"), naming.loose(F.concat("c_name", F.lit("_X"))).alias("loose"))


@registered("SELECT p_partkey, string_split(p_name, ' ')[1] || array_to_string(list_transform(string_split(p_name, ' ')[2:], lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), '') AS camel, CASE WHEN p_size % 3 = 0 THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2) ELSE 'Type' END AS stripped FROM part")
def op_f5_camel_case_and_prefixes(spark, sf_dir):
    p = R.read(spark, sf_dir, "part")
    prefixed = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("I"), F.upper(F.substring("p_name", 1, 1)), F.col("p_name").substr(F.lit(2), F.length("p_name")))).otherwise(F.lit("TType"))
    return p.select("p_partkey", naming.camel_case(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("camel"), naming.strip_prefix(prefixed).alias("stripped"))


@registered("WITH t AS (SELECT p_partkey, ['string','number','Custom','boolean'][1 + p_size % 4] AS a, ['String','i32','Custom','bool'][1 + p_size % 4] AS b FROM part) SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN b WHEN 1 THEN 'Result<' || b || '>' WHEN 2 THEN 'Vec<' || b || '>' ELSE 'HashMap<String, ' || b || '>' END AS translated FROM t")
def op_f8_translate_type(spark, sf_dir):
    p = R.read(spark, sf_dir, "part")
    a = F.element_at(F.array(*map(F.lit, ("string", "number", "Custom", "boolean"))), (F.col("p_size") % 4 + 1).cast("int"))
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, a).when(k == 1, F.concat(F.lit("Promise<"), a, F.lit(">"))).when(k == 2, F.concat(F.lit("Array<"), a, F.lit(">"))).otherwise(F.concat(F.lit("Record<string, "), a, F.lit(">")))
    return p.select("p_partkey", naming.translate_type(name).alias("translated"))


@registered("SELECT page_id, split_part(path, '/', 1) AS top_dir, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir_path, regexp_replace(path, '\\.[^./]+$', '.rs') AS target FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)")
def op_f3_paths(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    out = R.read(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return out.select("page_id", texts.top_dir(F.col("path")).alias("top_dir"), texts.dir_path(F.col("path")).alias("dir_path"), naming.target_path(F.col("path")).alias("target"))


@registered("SELECT doc_id, CASE WHEN len(l) >= 4 THEN array_to_string(l[2:4], chr(10)) ELSE '' END AS snippet, len(l) AS n_lines FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def op_p17_snippets(spark, sf_dir):
    return R.read(spark, sf_dir, "documents").select("doc_id", texts.snippet(F.col("text"), F.lit(2), F.lit(4)).alias("snippet"), texts.line_of(F.col("text"), F.length("text")).cast("long").alias("n_lines"))


@registered("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def op_f22_html_escape(spark, sf_dir):
    return R.read(spark, sf_dir, "pages").select("page_id", texts.html_escaped(F.col("html")).alias("escaped"))


@registered("SELECT event_id, CAST(regexp_extract(props, '\"k\": ?(-?[0-9]+)', 1) AS BIGINT) AS k, '[\"' || event_type || '\",\"' || user_id || '\"]' AS members FROM events")
def op_f28_json_columns(spark, sf_dir):
    return R.read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.array("event_type", F.col("user_id").cast("string"))).alias("members"))


@registered("""WITH s AS (SELECT o_custkey % 200 AS f, o_orderkey AS k, o_orderstatus AS r, o_totalprice > 200000 AS a, length(o_orderpriority) AS n FROM orders),
m AS (SELECT k, CASE WHEN x.n < 4 THEN 'struct' ELSE 'fn' END AS kind, x.s AS r, n FROM (SELECT l_orderkey AS k, min({'p': l_partkey, 'n': l_linenumber, 's': l_linestatus}) AS x, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)),
c AS (SELECT s.f, m.k IS NOT NULL AS found, coalesce(m.kind = 'struct', FALSE) AS kind_ok, coalesce(s.n % 4 + 1 = m.n, FALSE) AS p, m.k IS NOT NULL AND s.r = m.r AS r, m.k IS NOT NULL AND NOT s.a AS a FROM s LEFT JOIN m ON m.k = s.k),
g AS (SELECT 'file/' || f AS file, count(*) AS n_symbols, sum(found::INT)::DOUBLE / count(*) AS names, sum((kind_ok::INT + p::INT + r::INT + a::INT) / 4.0::DOUBLE) / count(*) AS st, sum((NOT found OR NOT kind_ok)::INT) AS errors FROM c GROUP BY 1)
SELECT file, n_symbols, round((names * 0.6::DOUBLE + st * 0.4::DOUBLE) * 10000) / 10000 AS similarity, CAST(errors AS BIGINT) AS errors, names * 0.6::DOUBLE + st * 0.4::DOUBLE >= 0.85 AND errors = 0 AS passed FROM g""")
def op_a23_verification(spark, sf_dir):
    o = R.read(spark, sf_dir, "orders")
    file = F.concat(F.lit("file/"), F.col("o_custkey") % 200)
    spec = o.select(file.alias("file"), F.concat(F.lit("get_Order_"), "o_orderkey").alias("target_name"), F.lit("interface").alias("kind"), (F.length("o_orderpriority") % 4 + 1).cast("long").alias("n_params"), F.col("o_orderstatus").alias("return_type"), (F.col("o_totalprice") > 200000).alias("is_async"))
    first = R.read(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.min(F.struct("l_partkey", "l_linenumber", "l_linestatus")).alias("x"), F.count("*").alias("n_params"))
    made = first.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(file.alias("file"), F.concat(F.lit("getOrder"), "l_orderkey").alias("name"), F.when(F.col("x.l_linenumber") < 4, "struct").otherwise("fn").alias("kind"), "n_params", F.col("x.l_linestatus").alias("return_type"), F.lit(False).alias("is_async"), F.col("x.l_partkey").alias("line"))
    out = tasks.verdicts(tasks.verification(spec, made))
    return out.withColumn("similarity", F.round(F.col("similarity") * 10000) / 10000)


@registered("""WITH s AS (SELECT DISTINCT c_mktsegment AS stem, c_nationkey AS k, c_custkey % 3 AS t FROM customer), g AS (SELECT DISTINCT c_mktsegment AS stem, s_nationkey AS k, s_suppkey % 3 AS t FROM customer JOIN supplier ON s_suppkey % 50 = c_custkey % 50)
SELECT count(*) AS total, count(*) FILTER (WHERE g.k IS NOT NULL) AS covered, count(*) FILTER (WHERE g.k IS NOT NULL)::DOUBLE / count(*) AS coverage, count(*) FILTER (WHERE g.k IS NOT NULL)::DOUBLE / count(*) >= 0.9 AS passed FROM s LEFT JOIN g USING (stem, k, t)""")
def op_j20_coverage(spark, sf_dir):
    c, s = R.read(spark, sf_dir, "customer"), R.read(spark, sf_dir, "supplier")
    kind = lambda k: F.element_at(F.array(*map(F.lit, ("added", "removed", "modified"))), (k % 3 + 1).cast("int"))
    source = c.select(F.col("c_mktsegment").alias("stem"), F.concat(F.lit("getNation"), "c_nationkey").alias("name"), F.concat(F.lit("get_nation"), "c_nationkey").alias("translated"), kind(F.col("c_custkey")).alias("change_type")).distinct()
    met = c.select("c_mktsegment", (F.col("c_custkey") % 50).alias("m")).distinct().join(s.withColumn("m", F.col("s_suppkey") % 50), "m")
    target = met.select(F.col("c_mktsegment").alias("stem"), F.concat(F.lit("GET_NATION"), "s_nationkey").alias("name"), kind(F.col("s_suppkey")).alias("change_type")).distinct()
    return tasks.coverage_summary(tasks.coverage(source, target))


@registered("""WITH s AS (SELECT DISTINCT 'src/n' || c_nationkey || '.ts' AS file, 'getSeg' || substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2)) AS name, c_nationkey AS k, c_mktsegment AS seg FROM customer),
t AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS seg FROM customer WHERE c_acctbal > 9000),
f AS (SELECT DISTINCT k FROM t),
m AS (SELECT s.file, s.name, min(CASE WHEN f.k IS NOT NULL THEN 'src/n' || s.k || '.rs' ELSE 'src/n' || t.k || '.rs' END) AS at FROM s LEFT JOIN f ON f.k = s.k JOIN t ON t.seg = s.seg AND (f.k IS NULL OR t.k = s.k) GROUP BY 1, 2)
SELECT s.file, s.name, coalesce(m.at, replace(s.file, '.ts', '.rs')) AS target_file, CASE WHEN m.at IS NOT NULL THEN 'get_seg_' || lower(s.seg) END AS target_name, CASE WHEN m.at IS NOT NULL THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM s LEFT JOIN m USING (file, name)""")
def op_j17_match_by_name(spark, sf_dir):
    c = R.read(spark, sf_dir, "customer")
    seg = F.concat(F.substring("c_mktsegment", 1, 1), F.lower(F.col("c_mktsegment").substr(F.lit(2), F.length("c_mktsegment"))))
    source = c.select(F.concat(F.lit("src/n"), "c_nationkey", F.lit(".ts")).alias("file"), F.concat(F.lit("getSeg"), seg).alias("name")).distinct()
    target = c.filter("c_acctbal > 9000").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("ordinal")).select(F.concat(F.lit("src/n"), "c_nationkey", F.lit(".rs")).alias("file"), F.concat(F.lit("get_seg_"), F.lower("c_mktsegment")).alias("name"), "ordinal")
    return align.match_by_name(source, target)


@registered("""WITH n AS (SELECT DISTINCT c_nationkey AS k FROM customer), t AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9900), makes AS (SELECT k FROM t WHERE k % 5 < 2), first AS (SELECT min({'n': 'make_' || k, 'f': 'src/n' || k || '.rs'}) AS m FROM makes),
asked AS (SELECT n.k, 'src/n' || n.k AS stem, t.k IS NOT NULL AS there, makes.k IS NOT NULL AS made FROM n LEFT JOIN t ON t.k = n.k LEFT JOIN makes ON makes.k = n.k)
SELECT stem || '.ts' AS file, 'getOwn' || k AS name, stem || '.rs' AS target_file, CASE WHEN there THEN 'get_own' || k END AS target_name, CASE WHEN there THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CASE WHEN there THEN 'name' ELSE 'none' END AS match_level FROM asked
UNION ALL SELECT stem || '.ts', 'lone' || k, CASE WHEN there THEN stem || '.rs' ELSE coalesce(m.f, stem || '.rs') END, CASE WHEN made THEN 'make_' || k WHEN NOT there THEN m.n END,
  CASE WHEN made OR NOT there AND m.n IS NOT NULL THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN made OR NOT there AND m.n IS NOT NULL THEN 'signature' ELSE 'none' END FROM asked, first""")
def op_d16_aligned(spark, sf_dir):
    c, k = R.read(spark, sf_dir, "customer"), F.col("c_nationkey")
    text = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    none = F.lit(None).cast("string")
    of = lambda df, end, name, types, returns: df.select(F.concat(F.lit("src/n"), k, F.lit(end)).alias("file"), F.concat(F.lit(name), k).alias("name"), F.lit(1).alias("ordinal"), types.alias("types"), returns.alias("returns"))
    all_, some = c.select(k).distinct(), c.filter("c_acctbal > 9900").select(k).distinct()
    source = of(all_, ".ts", "getOwn", text(), none).unionByName(of(all_, ".ts", "lone", text("string", "string"), F.lit("boolean"))).drop("ordinal")
    target = of(some, ".rs", "get_own", text(), none).unionByName(of(some.filter(k % 5 < 2), ".rs", "make_", text("String", "String"), F.lit("bool")))
    return align.aligned(source, target)


@registered(f"WITH {R.SOURCES} SELECT f.path AS module, CASE WHEN p % 2 = 0 THEN 'f' ELSE 'c' END || p AS name, CASE WHEN p % 2 = 0 THEN 'function' ELSE 'variable' END AS kind, p % 2 = 0 AS is_public, p % 2 = 0 AS is_async, CASE WHEN p % 2 = 0 THEN 'a: string' ELSE '' END AS params, CAST(7 + (SELECT coalesce(sum(CASE WHEN q.p % 2 = 0 THEN 3 ELSE 1 END), 0) FROM shipped q WHERE q.s = f.s AND q.p < shipped.p) AS INTEGER) AS line, CAST(7 + (SELECT coalesce(sum(CASE WHEN q.p % 2 = 0 THEN 3 ELSE 1 END), 0) FROM shipped q WHERE q.s = f.s AND q.p < shipped.p) + CASE WHEN p % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS line_end FROM files f JOIN shipped USING (s)")
def op_p2_symbols(spark, sf_dir):
    return extract_facts.symbols(R.source_files(spark, sf_dir)).select("module", "name", "kind", "is_public", "is_async", "params", "line", "line_end")


@registered(f"""WITH {R.LISTED} SELECT module, x.name || CASE WHEN x.name < 'd' THEN k ELSE '' END AS name, x.kind, x.is_public, x.is_async, x.params, CAST(x.line AS INTEGER) AS line
FROM listed, (VALUES ('a', 'variable', TRUE, FALSE, '', 1), ('b', 'function', TRUE, TRUE, 'x: number', 1), ('c', 'variable', TRUE, FALSE, '', 2), ('d', 'variable', TRUE, FALSE, '', 2)) x(name, kind, is_public, is_async, params, line)
UNION ALL SELECT module, 'default', CASE WHEN even THEN 'function' ELSE 'class' END, TRUE, FALSE, CASE WHEN even THEN 'a: string' ELSE '' END, 4 FROM listed""")
def op_p3_declarators(spark, sf_dir):
    return extract_facts.symbols(R.listed_files(spark, sf_dir)).select("module", "name", "kind", "is_public", "is_async", "params", "line")


@registered(f"WITH {R.SOURCES} SELECT module, specifier, FALSE AS is_external FROM imported UNION SELECT path, '@scope/pkg' || (s % 5) || '/lib', TRUE FROM files")
def op_p7_source_imports(spark, sf_dir):
    return extract_facts.imports(R.source_files(spark, sf_dir))


@registered(f"WITH {R.SOURCES} SELECT path AS module, '@scope/pkg' || (s % 5) AS package FROM files")
def op_d2_module_packages(spark, sf_dir):
    return extract_facts.module_packages(extract_facts.imports(R.source_files(spark, sf_dir)))


@registered(f"WITH {R.SOURCES} SELECT module, specifier, target FROM imported WHERE i < 2 AND target <> module AND target IN (SELECT path FROM files)")
def op_j1_resolved_imports(spark, sf_dir):
    files = R.source_files(spark, sf_dir)
    return extract_facts.resolved(extract_facts.imports(files), files)


@registered(f"WITH {R.SOURCES} SELECT module, 'g' || i AS local_name, 'f' || i AS exported_name, specifier FROM imported UNION ALL SELECT module, 'helper' || i, 'helper' || i, specifier FROM imported UNION ALL SELECT path, 'pkg', 'default', '@scope/pkg' || (s % 5) || '/lib' FROM files")
def op_p9_bindings(spark, sf_dir):
    return extract_facts.bindings(R.source_files(spark, sf_dir))


@registered(f"WITH {R.SOURCES}, uses AS (SELECT path AS module, 8 + (SELECT coalesce(sum(CASE WHEN q.p % 2 = 0 THEN 3 ELSE 1 END), 0) FROM shipped q WHERE q.s = f.s AND q.p < shipped.p) AS line FROM files f JOIN shipped USING (s) WHERE p % 2 = 0) SELECT target || ':f' || i AS target_symbol, module || ':g' || i AS source_symbol, module AS file, CAST(line AS INTEGER) AS line, CASE WHEN i = 0 THEN 9 ELSE 21 END AS col, CASE WHEN i = 0 THEN 'Call' ELSE 'New' END AS kind FROM imported JOIN uses USING (module) WHERE i < 2 AND target <> module AND target IN (SELECT path FROM files)")
def op_p12_references(spark, sf_dir):
    files = stored(R.source_files(spark, sf_dir), "sources")
    targets = extract_facts.resolved(extract_facts.imports(files), files)
    return extract_facts.references(files, extract_facts.bindings(files), targets).select("target_symbol", "source_symbol", "file", "line", "col", "kind")


@registered(f"WITH {R.SCOPED} SELECT * FROM scoped_uses")
def op_p14_scoped_references(spark, sf_dir):
    files = stored(R.scoped_files(spark, sf_dir), "sources")
    targets = extract_facts.resolved(extract_facts.imports(files), files)
    return extract_facts.references(files, extract_facts.bindings(files), targets)


@registered(f"WITH {R.SCOPED} SELECT target_symbol AS symbol, 'used by' AS direction, source_symbol AS other, kind, count(*) AS n, min(line) AS first_line FROM scoped_uses GROUP BY ALL UNION ALL SELECT source_symbol, 'uses', target_symbol, kind, count(*), min(line) FROM scoped_uses GROUP BY ALL")
def op_j5_reference_index(spark, sf_dir):
    return extract_facts.reference_index(op_p14_scoped_references(spark, sf_dir))


@registered("WITH o AS (SELECT conv_id || '/' || turn AS path, text FROM conversations), n AS (SELECT conv_id || '/' || (turn - 1) AS path, text FROM conversations), b AS (SELECT coalesce(o.path, n.path) AS path, o.text AS o, n.text AS n FROM o FULL JOIN n ON o.path = n.path WHERE o.text IS DISTINCT FROM n.text), lo AS (SELECT path, line, count(*) AS k FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM o) GROUP BY 1, 2), ln AS (SELECT path, line, count(*) AS k FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM n) GROUP BY 1, 2), c AS (SELECT coalesce(lo.path, ln.path) AS path, CAST(sum(greatest(coalesce(ln.k, 0) - coalesce(lo.k, 0), 0)) AS BIGINT) AS added, CAST(sum(greatest(coalesce(lo.k, 0) - coalesce(ln.k, 0), 0)) AS BIGINT) AS removed FROM lo FULL JOIN ln ON lo.path = ln.path AND lo.line = ln.line GROUP BY 1) SELECT path, CASE WHEN o IS NULL THEN 'A' WHEN n IS NULL THEN 'D' ELSE 'M' END AS status, added, removed FROM b JOIN c USING (path)")
def op_s12_changed_files(spark, sf_dir):
    c = R.read(spark, sf_dir, "conversations")
    path = lambda turn: F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string"))
    return trees.changed_files(c.select(path(F.col("turn")).alias("path"), F.col("text").alias("source")), c.select(path(F.col("turn") - 1).alias("path"), F.col("text").alias("source")))


@registered(f"""WITH {R.MOVED} SELECT 'new/c' || k AS path, 'old/c' || k AS old_path, 'R' AS status, 'M' AS normalised FROM moved WHERE segment = 'AUTOMOBILE' OR segment = 'BUILDING' AND shared >= 0.5 * (shared + more)
UNION ALL SELECT 'old/c' || k, NULL, 'D', 'D' FROM moved WHERE segment IN ('HOUSEHOLD', 'MACHINERY') UNION ALL SELECT 'new/c' || k, NULL, 'A', 'A' FROM moved WHERE segment = 'MACHINERY'""")
def op_s12_renames(spark, sf_dir):
    return renames.changes(R.moved_files(spark, sf_dir, 0), R.moved_files(spark, sf_dir, 1))


def _scanned(files):
    stmts = tokens.statements(tokens.tokens(files))
    declared = tokens.declarations(stmts)
    return stmts, declared, tokens.members(stmts, declared)


@registered(f"WITH {R.CLASSES} SELECT module, NULL AS parent, b AS name, 'class' AS kind, 2 AS line FROM classes UNION ALL SELECT module, b, 'name', 'property', 3 FROM classes UNION ALL SELECT 'src/' || b || '.ts', b, 'size' || n, 'method', CAST(line AS INTEGER) FROM methods UNION ALL SELECT module, x.parent, x.name, x.kind, CAST(last + x.line AS INTEGER) FROM classes, (VALUES (NULL, 'Kind', 'enum', 1), ('Kind', 'A', 'member', 1), ('Kind', 'C', 'member', 1), (NULL, 'make', 'function', 2), (NULL, 'build', 'function', 3)) x(parent, name, kind, line)")
def op_p19_all_symbols(spark, sf_dir):
    _, declared, members = _scanned(R.class_files(spark, sf_dir))
    return tokens.flattened(declared, members).drop("at")


@registered(f"WITH {R.CLASSES} SELECT module, b AS caller, 'u' AS callee FROM classes UNION ALL SELECT 'src/' || b || '.ts', b, 'other' || n FROM methods UNION ALL SELECT module, 'build', 'u' FROM classes")
def op_p15_calls(spark, sf_dir):
    return tokens.calls(*_scanned(R.class_files(spark, sf_dir)))


@registered(f"WITH {R.CLASSES} SELECT module, 'build' AS name, 'export function build(p: string, q: unknown, r: Map<string, number>) -> Promise<void>' AS signature FROM classes")
def op_p18_signatures(spark, sf_dir):
    files = R.class_files(spark, sf_dir)
    stmts, declared, _ = _scanned(files)
    return tokens.signatures(files, stmts, declared)


@registered(f"WITH {R.CLASSES} SELECT 'src/' || b || '.ts' AS module, b AS owner, 'size' || n AS name, b || '::size' || n || '(a: number, b: string) -> boolean' AS signature, CAST(line AS INTEGER) AS line FROM methods")
def op_p18_method_signatures(spark, sf_dir):
    files = R.class_files(spark, sf_dir)
    return tokens.method_signatures(files, *_scanned(files))


@registered("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_acctbal < 0 AS js FROM supplier)
SELECT 'src/s' || k || '.js' AS module, x.local_name, x.exported_name, x.specifier FROM s, (VALUES ('ns', '*', './n'), ('g', 'f', 'lib')) y(local_name, exported_name, specifier), LATERAL (SELECT y.local_name, CASE WHEN y.exported_name = 'f' THEN 'f' || n ELSE '*' END AS exported_name, y.specifier || n AS specifier) x WHERE js
UNION ALL SELECT 'src/s' || k || '.ts', 'h' || n, 'f', './n' || n FROM s WHERE NOT js""")
def op_p10_bindings_by_language(spark, sf_dir):
    n, js = F.col("s_nationkey"), F.col("s_acctbal") < 0
    lines = [F.concat(F.lit("import * as ns from './n"), n, F.lit("';")), F.concat(F.lit("import { f"), n, F.lit(" as g } from 'lib"), n, F.lit("';")), F.concat(F.lit("export { f as h"), n, F.lit(" } from './n"), n, F.lit("';"))]
    path = F.concat(F.lit("src/s"), "s_suppkey", F.when(js, ".js").otherwise(".ts"))
    files = R.read(spark, sf_dir, "supplier").select(path.alias("path"), F.concat_ws("\n", *lines).alias("source"), F.when(js, "javascript").otherwise("typescript").alias("language"))
    return extract_facts.bindings(files, reexported=True)


@registered(f"WITH {R.CLASSES} SELECT module, 'y' AS name, 'x' AS original, './x' AS specifier FROM classes")
def op_p4_reexports(spark, sf_dir):
    return extract_facts.reexports(R.class_files(spark, sf_dir))


@registered(f"WITH {R.RUST} SELECT module, 'N' || n AS parent, 'supp' || k AS name, 'method' AS kind, CAST(line AS INTEGER) AS line FROM supps UNION ALL SELECT module, 'N' || n, x.name, 'field', 2 FROM owners, (VALUES ('id'), ('name')) x(name) UNION ALL SELECT module, 'E', x.name, 'variant', CAST((SELECT max(line) FROM supps WHERE supps.n = owners.n) + 2 AS INTEGER) FROM owners, (VALUES ('A'), ('B')) x(name)")
def op_p5_rust_members(spark, sf_dir):
    _, _, members = _scanned(R.rust_files(spark, sf_dir))
    return members.select(F.col("path").alias("module"), "parent", "name", "kind", "line")


@registered(f"WITH {R.RUST} SELECT module, x.* FROM owners, (VALUES ('Item', 'Item', 'crate::shared'), ('Part', 'Thing', 'crate::shared::other')) x(local_name, exported_name, specifier)")
def op_p11_rust_bindings(spark, sf_dir):
    return extract_facts.bindings(R.rust_files(spark, sf_dir))


def _rust_targets(files):
    bound = extract_facts.bindings(files)
    return bound, extract_facts.resolved(bound.select("module", "specifier").distinct(), files)


@registered(f"WITH {R.RUST} SELECT module, x.* FROM owners, (VALUES ('crate::shared', 'src/shared.rs'), ('crate::shared::other', 'src/shared/other.rs')) x(specifier, target)")
def op_j4_rust_targets(spark, sf_dir):
    return _rust_targets(R.rust_files(spark, sf_dir))[1]


@registered(f"WITH {R.RUST} SELECT x.target_symbol, module || ':' || x.name AS source_symbol, module AS file, CAST(line AS INTEGER) AS line, CAST(x.col + length('supp' || k) AS INTEGER) AS col, x.kind FROM supps, (VALUES ('src/shared/other.rs:Thing', 'Part', 22, 'TypeReference'), ('src/shared.rs:Item', 'Item', 31, 'TypeReference'), ('src/shared.rs:Item', 'Item', 38, 'Call'), ('src/shared.rs:Item', 'Item', 38, 'Usage')) x(target_symbol, name, col, kind)")
def op_p13_rust_references(spark, sf_dir):
    files = R.rust_files(spark, sf_dir)
    return extract_facts.references(files, *_rust_targets(files))


@registered("SELECT DISTINCT 'src/' || replace(p_brand, '#', '') || '.ts' AS module, CASE WHEN p_size % 2 = 0 THEN '@/' ELSE '#lib/' END || 's' || p_size AS specifier, CASE WHEN p_size % 2 = 0 THEN 'app/' ELSE 'vendor/lib/' END || 's' || p_size || '.ts' AS target FROM part WHERE p_size IN (SELECT p_size FROM part WHERE p_type = 'ECONOMY')")
def op_j3_alias_targets(spark, sf_dir):
    """Sizes that some economy part has are files; aliases stand for folders, a longer one comes too late."""
    p = R.read(spark, sf_dir, "part")
    even = F.col("p_size") % 2 == 0
    found = p.select(F.concat(F.lit("src/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".ts")).alias("module"), F.concat(F.when(even, "@/").otherwise("#lib/"), F.lit("s"), "p_size").alias("specifier")).distinct()
    files = p.filter("p_type = 'ECONOMY'").select(F.concat(F.when(even, "app/").otherwise("vendor/lib/"), F.lit("s"), "p_size", F.lit(".ts")).alias("path")).distinct()
    aliases = spark.createDataFrame([("@/", "./app/", 0), ("#lib/", "vendor/lib/", 1), ("#lib/s1", "none", 2)], "prefix string, target string, at int")
    return extract_facts.resolved(found, files, aliases)


def _customers(spark, sf_dir):
    return R.read(spark, sf_dir, "customer").withColumn("module", F.concat(F.lit("cust/"), "c_custkey"))


def _specifications(spark, sf_dir):
    c = _customers(spark, sf_dir)
    used = R.read(spark, sf_dir, "orders").groupBy(F.concat(F.lit("cust/"), "o_custkey").alias("module")).agg(F.count("*").alias("n_users"))
    return reports.specifications(c.select("module"), used, c.filter("c_acctbal > 0").select(F.col("module").alias("id"), F.col("c_nationkey").alias("layer")), c.filter("c_acctbal > 5000").select("module", F.col("c_acctbal").alias("score"), F.col("c_custkey").alias("rank")))


SPECIFICATIONS = "spec AS (SELECT 'cust/' || c_custkey AS module, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_users, CASE WHEN c_acctbal > 0 THEN c_nationkey ELSE 0 END AS layer, CASE WHEN c_acctbal > 5000 THEN c_acctbal END AS score, CASE WHEN c_acctbal > 5000 THEN c_custkey END AS rank FROM customer)"


@registered(f"WITH {SPECIFICATIONS} SELECT * FROM spec")
def op_j12_specifications(spark, sf_dir):
    return _specifications(spark, sf_dir)


@registered(f"""WITH {SPECIFICATIONS} SELECT 'cust' AS directory, module AS path, '{{"n_users":' || n_users || ',"layer":' || layer || ',"symbols":[' || coalesce((SELECT string_agg('{{"name":"' || o_orderpriority || '","kind":"' || o_orderstatus || '"}}', ',' ORDER BY o_orderkey) FROM orders WHERE 'cust/' || o_custkey = module), '') || ']}}' AS document FROM spec""")
def op_k8_documents(spark, sf_dir):
    symbols = R.read(spark, sf_dir, "orders").select(F.concat(F.lit("cust/"), "o_custkey").alias("module"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("at"))
    return reports.documents(_specifications(spark, sf_dir).select("module", "n_users", "layer"), symbols)


@registered("SELECT c_custkey, c_name AS path FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def op_s16_in_directory(spark, sf_dir):
    return reports.in_directory(R.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("path")), "Customer#00000001")


@registered("SELECT 'cust/' || o_custkey || ':' || o_orderpriority AS key, o_orderpriority AS name, o_orderkey AS line FROM orders")
def op_s9_symbol_keys(spark, sf_dir):
    shards = R.read(spark, sf_dir, "orders").groupBy(F.concat(F.lit("cust/"), "o_custkey").alias("path")).agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("line"))).alias("symbols"))
    return reports.symbol_keys(shards)


STATES = f"{R.TASKS}, states AS (SELECT t.module, t.layer, t.in_degree, CASE WHEN bool_or(e.status = 'verified') THEN 'verified' ELSE max_by(e.status, e.at) END AS status, count(*) FILTER (WHERE e.status = 'in_progress') AS attempts FROM tasks t JOIN task_events e USING (module) GROUP BY 1, 2, 3)"


@registered(f"WITH {STATES} SELECT DISTINCT module, module AS target, states.status, event_type AS source, upper(event_type) AS target_name, 'function' AS kind, CASE states.status WHEN 'verified' THEN TRUE WHEN 'failed' THEN FALSE END AS present FROM states JOIN events ON module = 'user/' || user_id WHERE event_type <> 'signup'")
def op_j27_checklist(spark, sf_dir):
    e = R.read(spark, sf_dir, "events").filter("event_type <> 'signup'")
    symbols = e.select(F.concat(F.lit("user/"), "user_id").alias("module"), F.col("event_type").alias("name"), F.upper("event_type").alias("target_name"), F.lit("function").alias("kind")).distinct()
    return reports.checklist(_states(spark, sf_dir), symbols)


@registered(f"WITH {STATES} SELECT module, status FROM states WHERE status <> 'verified'")
def op_k9_todo(spark, sf_dir):
    return reports.todo(_states(spark, sf_dir)).select("module", "status")


@registered(f"WITH {STATES} SELECT module, layer, in_degree, 'in_progress' AS status, attempts, (SELECT count(*) FILTER (WHERE status = 'pending') > 1 OR count(*) FILTER (WHERE status = 'verified') > 0 FROM states) AS has_next FROM states WHERE status = 'pending' ORDER BY layer, in_degree DESC, module LIMIT 1")
def op_k5_next_response(spark, sf_dir):
    return reports.next_response(_states(spark, sf_dir))


@registered(f"WITH {STATES} SELECT module, layer, in_degree, status, attempts FROM states WHERE status = 'failed'")
def op_t3_listed_tasks(spark, sf_dir):
    return tasks.listed(_states(spark, sf_dir), "failed")


@registered(f"WITH {R.TASKS} SELECT * FROM tasks")
def op_t5_layer_members(spark, sf_dir):
    return reports.layer_members(R.tasks(spark, sf_dir))


@registered("SELECT 'cust/' || o_custkey AS module, count(*) AS n_symbols FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def op_t6_largest_modules(spark, sf_dir):
    return reports.largest_modules(R.read(spark, sf_dir, "orders").select(F.concat(F.lit("cust/"), "o_custkey").alias("module")))


@registered("""WITH m AS (SELECT o_custkey, count(*) AS n_symbols FROM orders GROUP BY 1), top AS (SELECT 'cust/' || o_custkey AS module, o_custkey, n_symbols, row_number() OVER (ORDER BY n_symbols DESC, 'cust/' || o_custkey) AS module_place FROM m),
x AS (SELECT t.module, module_place, n_symbols, o_orderkey AS name, o_orderstatus AS kind, row_number() OVER (PARTITION BY t.module ORDER BY o_orderdate, o_orderkey) AS place FROM top t JOIN orders o USING (o_custkey) WHERE module_place <= 20)
SELECT module, CAST(module_place AS INTEGER) AS module_place, n_symbols, CAST(name AS VARCHAR) AS name, kind, CAST(place AS INTEGER) AS place FROM x WHERE place <= 30""")
def op_t6_api_surface(spark, sf_dir):
    o = R.read(spark, sf_dir, "orders").select(F.concat(F.lit("cust/"), "o_custkey").alias("module"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderstatus").alias("kind"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return reports.api_surface(o)


@registered("WITH ch AS (SELECT DISTINCT p_brand AS path FROM part), d AS (SELECT DISTINCT p_brand AS path, p_type AS package FROM part WHERE p_size > 45), r AS (SELECT DISTINCT p_type AS package, lower(p_type) AS effort FROM part WHERE p_type < 'P') SELECT path, package, effort FROM ch LEFT JOIN (SELECT d.path, package, effort FROM d JOIN r USING (package)) USING (path)")
def op_j23_changed_recommendations(spark, sf_dir):
    p = R.read(spark, sf_dir, "part")
    recommended = p.filter("p_type < 'P'").select(F.col("p_type").alias("package"), F.lower("p_type").alias("effort")).distinct()
    return reports.changed_recommendations(p.select(F.col("p_brand").alias("path")).distinct(), p.filter("p_size > 45").select(F.col("p_brand").alias("module"), F.col("p_type").alias("package")), recommended)


def _dependency_notes(spark, sf_dir):
    s = R.read(spark, sf_dir, "supplier")
    none = F.array().cast("array<string>")
    changes = s.select(F.concat(F.lit("Supp"), "s_suppkey").alias("package"), F.when(F.col("s_acctbal") < 3000, "unknown").otherwise("heavy").alias("effort"), F.when(F.col("s_nationkey") > 12, "own").alias("guidance"), F.when(F.col("s_acctbal") > 6000, F.array(F.lit("own"), F.lit("ffi"))).otherwise(none).alias("risk_tags"), (F.col("s_nationkey") < 3).alias("needs_review"))
    known = s.filter("s_nationkey > 4").select(F.concat(F.lit("SUPP"), "s_suppkey").alias("package"), F.lit("moderate").alias("effort"), F.lit("read on").alias("guidance"), F.array(F.lit("ssr")).alias("risk_tags"))
    return reports.enriched(changes, known)


NOTES = "notes AS (SELECT 'Supp' || s_suppkey AS package, CASE WHEN s_acctbal >= 3000 THEN 'heavy' WHEN s_nationkey > 4 THEN 'moderate' ELSE 'unknown' END AS effort, CASE WHEN s_nationkey > 12 THEN 'own' WHEN s_nationkey > 4 THEN 'read on' END AS guidance, CASE WHEN s_acctbal > 6000 THEN 'own,ffi' WHEN s_nationkey > 4 THEN 'ssr' ELSE '' END AS risk_tags, s_nationkey < 3 AS needs_review FROM supplier)"


@registered(f"WITH {NOTES} SELECT * FROM notes")
def op_j24_enriched_changes(spark, sf_dir):
    return _dependency_notes(spark, sf_dir).withColumn("risk_tags", F.array_join("risk_tags", ","))


@registered(f"WITH {NOTES} SELECT risk, count(*) AS n FROM (SELECT unnest(string_split(risk_tags, ',')) AS risk FROM notes) WHERE risk <> '' GROUP BY 1")
def op_a25_risks(spark, sf_dir):
    return reports.risks(_dependency_notes(spark, sf_dir))


@registered(f"WITH {NOTES} SELECT package, effort, needs_review FROM notes WHERE effort IN ('heavy', 'rewrite') OR needs_review")
def op_a25_to_review(spark, sf_dir):
    return reports.to_review(_dependency_notes(spark, sf_dir)).select("package", "effort", "needs_review")


@registered(f"WITH {CHANGES}, {EVALUATED}, x AS (SELECT ch.*, coalesce(ev.level, 'unknown') AS level FROM ch LEFT JOIN ev USING (package)), y AS (SELECT *, CASE change_type WHEN 'added' THEN level IN ('unknown', 'none') WHEN 'removed' THEN level IN ('full', 'partial') ELSE level IN ('partial', 'unknown') END AS needs_review FROM x) SELECT * FROM (SELECT count(*) AS total_changed_files, count(*) FILTER (WHERE p_size > 2) AS source_files_changed, count(*) FILTER (WHERE p_size <= 2) AS dep_files_changed FROM part), (SELECT count(*) FILTER (WHERE change_type = 'added') AS deps_added, count(*) FILTER (WHERE change_type = 'removed') AS deps_removed, count(*) FILTER (WHERE change_type IN ('upgraded', 'downgraded')) AS deps_modified, count(*) FILTER (WHERE needs_review) AS deps_needing_review FROM y)")
def op_a16_update_summary(spark, sf_dir):
    name = F.when(F.col("p_size") == 1, "package.json").when(F.col("p_size") == 2, "Cargo.lock").otherwise("package.json.ts")
    files = R.read(spark, sf_dir, "part").select(F.concat_ws("/", F.lit("src"), "p_partkey", name).alias("path"))
    return reports.update_summary(files, compat.reviewed(_changes(spark, sf_dir), _evaluated(spark, sf_dir)))


@registered(f"WITH v AS ({ORACLE_SQL['op_a23_verification']}) SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS verified, count(*) FILTER (WHERE NOT passed) AS failed, 'Batch verification: ' || count(*) FILTER (WHERE passed) || '/' || count(*) || ' verified, ' || count(*) FILTER (WHERE NOT passed) || '/' || count(*) || ' failed' AS summary FROM v")
def op_a24_batch_totals(spark, sf_dir):
    return reports.batch_totals(op_a23_verification(spark, sf_dir))


def _deep_checks(spark, sf_dir):
    files = R.generated_files(spark, sf_dir)
    every = rust_items.read(files)
    broken = settled(rust_items.unbalanced(files, every).withColumnRenamed("path", "file"))
    return tasks.deep_checks(R.specifications(spark, sf_dir), rust_items.items(files, every).withColumnRenamed("path", "file"), broken), broken


@registered(f"WITH {R.GENERATED} SELECT file, name, found, severity, message, expected, actual, line_hint FROM checked")
def op_j26_deep_checks(spark, sf_dir):
    return _deep_checks(spark, sf_dir)[0].drop("at")


@registered(f"""WITH {R.GENERATED}, sums AS (SELECT file, count(*) AS n_symbols, count(*) FILTER (WHERE found) AS matched, count(*) FILTER (WHERE found AND severity IS NULL) AS correct, string_agg(message, '; ' ORDER BY at_) AS messages FROM checked GROUP BY file),
v AS (SELECT *, matched / n_symbols * 0.6::DOUBLE + CASE WHEN matched > 0 THEN correct / matched ELSE 0 END * 0.4::DOUBLE AS similarity FROM sums)
SELECT file, n_symbols, matched, correct, round(similarity * 10000) / 10000 AS similarity, CASE WHEN similarity >= 0.5 AND matched = n_symbols THEN 'verified' ELSE 'needs_revision' END AS status,
  CASE WHEN similarity >= 0.5 AND matched = n_symbols THEN 'File ''' || file || ''' deep-verified — ' || correct || '/' || n_symbols || ' symbols match structurally.'
  ELSE 'File ''' || file || ''' needs revision — ' || matched || '/' || n_symbols || ' symbols found, ' || correct || '/' || greatest(matched, 1) || ' structurally correct. Issues: ' || messages END AS instruction FROM v""")
def op_k14_deep_verdicts(spark, sf_dir):
    out = tasks.deep_verdicts(*_deep_checks(spark, sf_dir), threshold=0.5)
    return out.withColumn("similarity", F.round(F.col("similarity") * 10000) / 10000)


@registered(f"""WITH {R.GENERATED} SELECT file AS path, CASE segment WHEN 'MACHINERY' THEN 'GetCust' ELSE 'get_cust_' END || k AS name, CASE segment WHEN 'MACHINERY' THEN 'struct' ELSE 'function' END AS kind,
  CASE segment WHEN 'AUTOMOBILE' THEN 'pub fn get_cust_' || k || '(acc_bal: f64, seg: Vec < String >) -> Result < u32 , E >' WHEN 'BUILDING' THEN 'pub fn get_cust_' || k || '(acc_bal: f64) -> Result < u32 , E >' ELSE 'pub struct GetCust' || k || '<T> {{ ... }}' END AS signature,
  CASE segment WHEN 'AUTOMOBILE' THEN 'Customer ' || k || '.' END AS doc FROM asked WHERE segment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')""")
def op_p18_rust_signatures(spark, sf_dir):
    return rust_items.signatures(rust_items.items(R.generated_files(spark, sf_dir))).drop("owner")


@registered("SELECT count(*) AS total, count(*) FILTER (WHERE s_nationkey < 5) AS available, count(*) FILTER (WHERE s_nationkey BETWEEN 5 AND 9) AS partial, count(*) FILTER (WHERE s_nationkey > 9) AS unavailable FROM supplier")
def op_a22_availability(spark, sf_dir):
    s = R.read(spark, sf_dir, "supplier").withColumn("package", F.col("s_suppkey").cast("string"))
    status = F.when(F.col("s_nationkey") < 5, "available").when(F.col("s_nationkey") < 10, "partial").otherwise("gone")
    return reports.availability(s.select("package"), s.filter("s_nationkey < 20").select("package", status.alias("status")))


@registered(f"WITH f AS ({ORACLE_SQL['op_j15_file_versions']}), c AS (SELECT conv_id || '/' || turn AS path, role AS name, 'function' AS kind FROM conversations UNION SELECT conv_id || '/' || (turn - 1), role, 'function' FROM conversations) SELECT path, name, kind, status AS change_type, CASE status WHEN 'removed' THEN 'high' ELSE 'low' END AS severity FROM f JOIN c USING (path) WHERE status IN ('added', 'removed')")
def op_d12_whole_files(spark, sf_dir):
    c = R.read(spark, sf_dir, "conversations")
    of = lambda turn: c.select(F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string")).alias("path"), F.col("role").alias("name"), F.lit("function").alias("kind"))
    symbols = of(F.col("turn")).union(of(F.col("turn") - 1)).distinct()
    return reports.whole_file_changes(op_j15_file_versions(spark, sf_dir), symbols)


@registered("SELECT o.conv_id || '/' || o.turn AS path, array_to_string(string_split(o.text, chr(10))[1:1], chr(10)) AS old_snippet, CASE WHEN n.text IS NOT NULL AND len(string_split(n.text, chr(10))) >= 2 THEN array_to_string(string_split(n.text, chr(10))[1:2], chr(10)) ELSE '' END AS new_snippet FROM conversations o LEFT JOIN conversations n ON n.conv_id = o.conv_id AND n.turn = o.turn + 1")
def op_d14_snippets(spark, sf_dir):
    c = R.read(spark, sf_dir, "conversations")
    of = lambda turn: c.select(F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string")).alias("path"), F.col("text").alias("source"))
    old = of(F.col("turn"))
    places = {"old_start": 1, "old_end": 1, "new_start": 1, "new_end": 2}
    changes = old.select("path", *[F.lit(v).alias(k) for k, v in places.items()])
    return reports.with_snippets(changes, old, of(F.col("turn") - 1)).select("path", "old_snippet", "new_snippet")


@registered("SELECT 'p' || p_partkey AS root, CASE WHEN p_size < 10 THEN 'error' WHEN p_size < 20 THEN 'typescript' WHEN p_size < 30 THEN 'javascript' WHEN p_size < 40 THEN 'rust' ELSE 'unknown' END AS language FROM part")
def op_s15_languages(spark, sf_dir):
    n = F.col("p_size")
    names = F.when(n < 10, F.array(F.lit("package.json"), F.lit("Cargo.toml"))).when(n < 20, F.array(F.lit("package.json"), F.lit("tsconfig.json"))).when(n < 30, F.array(F.lit("package.json"))).when(n < 40, F.array(F.lit("Cargo.toml"))).otherwise(F.array(F.lit("README.md")))
    return reports.languages(R.read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("root"), F.explode(names).alias("name")))


@registered("SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'STANDARD') THEN 'unknown' ELSE 'full' END AS level, p_size * 1.0::DOUBLE / 50 * 100 AS share, p_size = 1 AS is_dependency, p_size > 40 AS is_script, p_size < 5 AS todo, FALSE AS deprecated, p_size >= 45 AS unsafe FROM part")
def op_f16_scalar_rules(spark, sf_dir):
    p, n = R.read(spark, sf_dir, "part"), F.col("p_size")
    path = F.when(n == 1, "a/Cargo.lock").when(n > 40, "a/xCargo.lock.tsx").otherwise("a/Cargo.lock.md")
    flags = texts.doc_flags(F.when(n < 5, "see FIXME").when(n >= 45, "SAFETY: none").when(n < 20, "plain"), F.array(F.lit("test")))
    written = F.when(F.col("p_type").isin("PROMO", "STANDARD"), F.col("p_type")).otherwise("  FULL ")
    return p.select("p_partkey", levels.parsed(written, levels.LEVEL_SCORE).alias("level"), levels.percent(n, F.lit(50), 0.0).alias("share"), texts.is_dependency_file(path).alias("is_dependency"), texts.has_extension(path, ["ts", "tsx"]).alias("is_script"), *[flags[k].alias(k) for k in ("todo", "deprecated", "unsafe")])


@registered("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'new' ELSE p_brand END AS value FROM part")
def op_k2_upsert(spark, sf_dir):
    p = R.read(spark, sf_dir, "part")
    return tasks.upsert(p.select("p_partkey", F.col("p_brand").alias("value")), p.filter("p_size > 25").select("p_partkey", F.lit("new").alias("value")), "p_partkey")


@registered("SELECT p_partkey, 0.4::DOUBLE + CASE WHEN p_size < 10 THEN 0.3 WHEN p_size < 30 THEN 0.15 ELSE 0.0 END + CASE WHEN p_size < 10 THEN 0.2 WHEN p_size < 30 THEN 0.2 / 3 ELSE 0.0 END + CASE WHEN p_brand < 'Brand#2' THEN 0.1 ELSE 0.0 END AS similarity FROM part")
def op_a13_signature_similarity(spark, sf_dir):
    p, n = R.read(spark, sf_dir, "part"), F.col("p_size")
    types = F.when(n < 10, F.array(*map(F.lit, ("string", "number", "boolean")))).when(n < 30, F.array(F.lit("string"))).otherwise(F.array().cast("array<string>"))
    a = {"name": F.concat(F.lit("getPart"), "p_partkey"), "types": types, "returns": F.when(F.col("p_brand") < "Brand#2", "string").otherwise("number")}
    b = {"name": naming.snake_case(F.concat(F.lit("getPart"), "p_partkey")), "types": F.array(*map(F.lit, ("String", "i32", "bool"))), "returns": F.lit("String")}
    return p.select("p_partkey", align.signature_similarity(a, b).alias("similarity"))


@registered("SELECT p_partkey, CASE WHEN p_size < 20 THEN 2.0::DOUBLE / 3 ELSE 1.0::DOUBLE / 3 END AS share FROM part")
def op_a14_children_similarity(spark, sf_dir):
    source = F.array(F.lit("getSize"), F.lit("name"), F.col("p_type"))
    target = F.when(F.col("p_size") < 20, F.array(F.lit("get_size"), F.lower("p_type"))).otherwise(F.array(F.lit("name")))
    return R.read(spark, sf_dir, "part").select("p_partkey", align.children_similarity(source, target).alias("share"))


@registered("SELECT * FROM (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS added, count(*) FILTER (WHERE o_orderstatus = 'O') AS removed, count(*) FILTER (WHERE o_orderstatus = 'P') AS modified, 0::BIGINT AS renamed, count(*) FILTER (WHERE o_totalprice > 200000) AS breaking FROM orders), (SELECT count(*) FILTER (WHERE n_regionkey < 2) AS imports_added, count(*) FILTER (WHERE n_regionkey >= 2) AS imports_removed FROM nation)")
def op_a15_diff_summary(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "added").when(F.col("o_orderstatus") == "O", "removed").otherwise("modified")
    changes = R.read(spark, sf_dir, "orders").select(kind.alias("change_type"), F.when(F.col("o_totalprice") > 200000, "breaking").otherwise("compatible").alias("severity"))
    return diff.summary(changes, R.read(spark, sf_dir, "nation").select(F.when(F.col("n_regionkey") < 2, "added").otherwise("removed").alias("change_type")))


@registered("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'iter_map,unwrap,eco' ELSE 'iter_map,unwrap,' || p_type END AS calls FROM part")
def op_f9_api_calls(spark, sf_dir):
    rules = naming.Conventions(calls={"map": "iter_map", "ECONOMY": "eco"})
    return R.read(spark, sf_dir, "part").select("p_partkey", F.array_join(naming.translate_calls(F.array(F.lit("map"), F.lit("unwrap"), F.col("p_type")), rules), ",").alias("calls"))


@registered("SELECT p_partkey, array_to_string(list_transform(['.test.rs', '.test.ts', '.spec.ts'], lambda e: 'src/' || CASE WHEN p_size = 1 THEN 'index' ELSE 'p' || p_partkey END || e), ',') || CASE WHEN p_size = 1 THEN ',src/mod.test.rs,src/mod.spec.ts,src/index.test.ts,src/index.spec.ts' ELSE '' END AS names FROM part")
def op_f26_test_names(spark, sf_dir):
    path = F.concat(F.lit("src/"), F.when(F.col("p_size") == 1, "index").otherwise(F.concat(F.lit("p"), "p_partkey")), F.lit(".ts"))
    return R.read(spark, sf_dir, "part").select("p_partkey", F.array_join(texts.test_candidates(path), ",").alias("names"))


@registered("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 0.15 WHEN 1 THEN 0.45 WHEN 2 THEN 1.0 ELSE 0.5 END::DOUBLE AS effort_score, s_suppkey % 4 = 2 AS heavy FROM supplier")
def op_f15_effort_scores(spark, sf_dir):
    effort = levels.default_effort(R.level(F.col("s_suppkey")))
    return R.read(spark, sf_dir, "supplier").select("s_suppkey", levels.effort_score(effort).alias("effort_score"), levels.is_high_impact(effort).alias("heavy"))


@registered(f"WITH {CHANGES} SELECT package, coalesce(change_type = 'upgraded' AND CAST(regexp_extract(new_version, 'v([0-9]+)', 1) AS INTEGER) > CAST(regexp_extract(old_version, 'v([0-9]+)', 1) AS INTEGER), FALSE) AS major FROM ch")
def op_f18_major_upgrades(spark, sf_dir):
    return _changes(spark, sf_dir).select("package", levels.is_major(F.col("old_version"), F.col("new_version")).alias("major"))
