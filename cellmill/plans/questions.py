"""Queries of question generation, manifests and data quality, with equal SQL.

Objects are parts seen in orders; brand, type and size class are their attributes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cellmill import roles
from cellmill.operators import quality as U
from cellmill.operators import questions as G
from cellmill.plans.cells import rounded
from cellmill.sources.tables import table

FRAME = ["frame"]


#: Lines of a task that works on whole orders.
LINES = 250_000


def _objects(spark, sf, *columns, dealt=True):
    """Parts seen in orders, each once, with the named attributes. Dealt by order over as many tasks as there are lines for, so a task's rows don't grow
    with the tables, and what follows works on an order where it is. Not dealt, parts stay where they are read, and repeat."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part").withColumn("size_class", F.pmod("p_size", F.lit(5)).cast("string"))
    seen = li.select(F.col("l_orderkey").alias("frame"), F.col("l_partkey").alias("item"))
    seen = seen.join(p, F.col("item") == F.col("p_partkey")).select("frame", "item", *columns)
    if not dealt:
        return seen
    tasks = max(spark.sparkContext.defaultParallelism, -(-li.count() // LINES))
    return seen.repartition(tasks, "frame").distinct()


_ATTRIBUTES = {"brand": "p_brand", "type": "p_type", "size": "size_class"}


def _attrs(spark, sf, *names, dealt=True):
    """Rows of the named attributes (all, if none is named)."""
    chosen = {n: _ATTRIBUTES[n] for n in names or _ATTRIBUTES}
    o = _objects(spark, sf, *chosen.values(), dealt=dealt)
    return o.select("frame", "item", F.explode(F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(c).alias("value")) for n, c in chosen.items()])).alias("a")).select("frame", "item", "a.*")


def attr_unique_owner(spark, sf):
    return G.unique_owner(_attrs(spark, sf), FRAME, "item", "attribute", "value")


def attr_composition(spark, sf):
    return G.compositions(_attrs(spark, sf, "brand", "size"), FRAME, "item", "brand", "size")


def attr_count(spark, sf):
    return G.counts(_attrs(spark, sf, "brand"), FRAME, "item", "value")


def attr_odd_one_out(spark, sf):
    return G.odd_one_out(_attrs(spark, sf, "size"), FRAME, "item", "value")


def attr_absent(spark, sf):
    """Size classes that an order's parts lack."""
    return G.absent_values(_attrs(spark, sf, "size"), FRAME, "value")


def synonym_yes(spark, sf):
    """Types as other names of parts, where no other part of the order goes by them."""
    o = _objects(spark, sf, "p_brand", "p_type").select("frame", "item", F.col("p_brand").alias("canonical"), F.col("p_type").alias("alias"))
    return G.synonyms(o, FRAME, "item", "canonical", "alias")


def _placed(spark, sf):
    return _objects(spark, sf, "p_size", "p_retailprice").select("frame", "item", F.pmod("item", F.lit(64)).cast("double").alias("x"), F.pmod(F.col("item") * 7, F.lit(48)).cast("double").alias("y"), F.col("p_size").cast("double").alias("area"), F.col("p_retailprice").alias("depth"))


def spatial_pairs(spark, sf):
    return G.spatial_pairs(_placed(spark, sf), FRAME, "item", "x", "y", 64.0, 48.0)


def spatial_extremes(spark, sf):
    return G.extremes(_placed(spark, sf), FRAME, "item", {"leftmost": ("x", False), "rightmost": ("x", True), "topmost": ("y", False), "largest": ("area", True), "closest": ("depth", False)})


def spatial_farthest(spark, sf):
    return G.farthest_pair(_placed(spark, sf), FRAME, "item", "x", "y", "area")


def incontext_reference(spark, sf):
    """For a part with a brand of its own in an order, a part outside the order with the same brand."""
    o = _objects(spark, sf, "p_brand").select("frame", "item", F.col("p_brand").alias("value"))
    catalog = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("value"))
    return G.references(o, catalog, "value", FRAME, "item", "ref")


def mcq_options(spark, sf):
    """Four options for the type of each part, and the letter of the right one."""
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("q"), F.col("p_type").alias("answer"))
    pool = table(spark, sf, "part").select(F.col("p_type").alias("option"))
    return G.options(q, pool, ["q"], "answer", "opt").select("q", "answer", F.concat_ws("|", "options").alias("options"), "letter")


def mcq_accuracy(spark, sf):
    """Labels as answers, with stand-in predictions for some of them."""
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    s = lab.select("doc_id", F.col("quality").alias("answer"), "lang", "source")
    p = lab.filter("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("answer"))
    return rounded(G.score_answers(s, p, "doc_id", ["lang", "source"]))


def semantic_dedup(spark, sf):
    """Events whose kind-dependent identity occurred before: a click by user and minute, others by user and field."""
    e = table(spark, sf, "events")
    minute, k = F.date_format(F.date_trunc("MINUTE", "ts"), "yyyy-MM-dd HH:mm"), F.get_json_object("props", "$.k")
    kinds = {t: ([F.col("user_id").cast("string"), minute] if t == "click" else [F.col("user_id").cast("string"), k]) for t in ("click", "view", "purchase", "signup", "scroll")}
    keyed = e.withColumn("key", G.semantic_key(F.col("event_type"), kinds)).filter("key IS NOT NULL")
    return keyed.groupBy("key").agg(F.min("event_id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.sha2("key", 256).alias("key"), "kept", "n")


def drop_reasons(spark, sf):
    li = table(spark, sf, "lineitem")
    reason = F.when(F.col("l_quantity") < 3, "fragment").when(F.col("l_discount") == 0, "no_depth").when(F.col("l_returnflag") == "R", "ambiguous")
    return G.drop_reasons(li.select(F.col("l_linestatus").alias("type"), reason.alias("reason")).filter("reason IS NOT NULL"), "type", "reason")


def frame_manifest(spark, sf):
    """Frames with their modality flags, tier and file names."""
    s = roles.samples(spark, sf).select("scene", "phase", "frame", "model").distinct()
    t = roles.scenes(spark, sf).select("scene", "tier")
    flags = s.groupBy("scene", "phase", "frame").agg(*[F.max((F.col("model") == m).cast("int")).cast("boolean").alias(f"has_{n}") for m, n in (("A", "rgb"), ("N", "depth"), ("R", "mask"))])
    name = F.format_string("scene_%05d/%s/%06d.png", F.col("scene"), F.col("phase"), F.col("frame"))
    return flags.join(t, "scene", "left").select("scene", "phase", "frame", "tier", "has_rgb", "has_depth", "has_mask", name.alias("path")).filter("has_rgb AND has_depth AND has_mask")


def clip_entries(spark, sf):
    """Ordered frames of each clip that has at least four."""
    m = frame_manifest(spark, sf)
    return m.groupBy("scene", "phase").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("frame")), lambda f: f.cast("string"))).alias("frames"), F.count(F.lit(1)).alias("n")).filter("n >= 4")


def shard_flags(spark, sf):
    """Shards by modality as columns, and the units that lack one."""
    s = roles.samples(spark, sf).groupBy("scene", "model").agg(F.min("sample").alias("shard"))
    return s.groupBy("scene").pivot("model", ["A", "N", "R"]).agg(F.min("shard")).select("scene", *[F.col(m).alias(f"shard_{m.lower()}") for m in "ANR"], (F.col("A").isNull() | F.col("N").isNull() | F.col("R").isNull()).alias("incomplete"))


def allow_patterns(spark, sf):
    """Scene patterns by modality."""
    n = table(spark, sf, "nation").select(F.format_string("scene_%03d", F.col("n_nationkey")).alias("scene"))
    kinds = spark.createDataFrame([("rgb", None), ("depth", None), ("masks", "v2"), ("pose", "current")], "kind string, label string")
    version = F.when(F.col("label") == "current", "v1").otherwise(F.coalesce("label", F.lit("v1")))
    return n.crossJoin(F.broadcast(kinds)).select(F.when(F.col("kind") == "masks", F.concat_ws("/", "scene", "kind", version, F.lit("*"))).otherwise(F.concat_ws("/", "scene", "kind", F.lit("*"))).alias("pattern"))


def row_count_expectations(spark, sf):
    names = ("region", "nation", "customer", "orders")
    return U.row_counts({n: table(spark, sf, n) for n in names}, {"region": 5, "nation": 25, "customer": 150})


def dup_keys(spark, sf):
    return U.duplicates(table(spark, sf, "orders"), "o_custkey", "o_orderdate")


def unit_status(spark, sf):
    li = table(spark, sf, "lineitem")
    errors = {"discount": F.col("l_discount") > 0.1, "quantity": F.col("l_quantity") <= 0, "late": F.col("l_shipdate") >= F.lit("1998-10-01").cast("timestamp_ntz")}
    out = U.unit_status(li, ["l_suppkey"], {"late": errors["late"], "quantity": errors["quantity"]}, {"cheap": F.col("l_extendedprice") < 950})
    return out.select("l_suppkey", "status", "n", F.concat_ws(",", "errors").alias("errors"), F.concat_ws(",", "warnings").alias("warnings"))


def completeness_gaps(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("p_name"), F.when(F.col("p_partkey") % 7 == 0, F.lit(" ")).otherwise(F.col("p_type")).alias("p_type"))
    return U.completeness(p, "p_partkey", "p_name", "p_type").select("p_partkey", F.concat_ws(",", "gaps").alias("gaps"))


def checksum_status(spark, sf):
    d = table(spark, sf, "benchmark").select(F.col("item_id").alias("k"), F.sha2("text", 256).alias("v"))
    expected = d.select("k", F.when(F.col("k") % 9 == 0, F.lit("other")).otherwise(F.col("v")).alias("v")).unionByName(d.select((F.col("k") + 1000).alias("k"), "v"))
    return U.checksums(d, expected, "k", "v")


def split_integrity(spark, sf):
    """Scenes whose cells carry more than one tier, or that lack a phase."""
    c = roles.samples(spark, sf).groupBy("scene", "phase").agg(F.min_by("model", F.struct("sample", "model")).alias("tier"))
    return U.split_integrity(c, "scene", "tier", 3)


def orphan_rows(spark, sf):
    return U.orphans(table(spark, sf, "lineitem").select((F.col("l_partkey") + 3).alias("k")), table(spark, sf, "part"), "k", "p_partkey")


def not_finite(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 13 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return U.not_finite(c, ["c_custkey"], "c_acctbal").select("c_custkey", F.concat_ws(",", "columns").alias("columns"))


def sequence_summary(spark, sf):
    return U.sequence_summary(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")


QUERIES = {f.__name__: f for f in (
    attr_unique_owner, attr_composition, attr_count, attr_odd_one_out, attr_absent, synonym_yes, spatial_pairs, spatial_extremes, spatial_farthest, incontext_reference, mcq_options, mcq_accuracy,
    semantic_dedup, drop_reasons, frame_manifest, clip_entries, shard_flags, allow_patterns, row_count_expectations, dup_keys, unit_status, completeness_gaps, checksum_status, split_integrity,
    orphan_rows, not_finite, sequence_summary,
)}

_O = """o AS (SELECT DISTINCT l_orderkey AS frame, l_partkey AS item, p_brand, p_type, CAST(p_size % 5 AS VARCHAR) AS size_class, p_size, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_A = f"{_O}, a AS (SELECT frame, item, 'brand' AS attribute, p_brand AS value FROM o UNION ALL SELECT frame, item, 'type', p_type FROM o UNION ALL SELECT frame, item, 'size', size_class FROM o)"
_P = f"{_O}, p AS (SELECT frame, item, CAST(item % 64 AS DOUBLE) AS x, CAST(item * 7 % 48 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS area, p_retailprice AS depth FROM o)"
_ext = lambda c, f: f"CASE WHEN count(*) FILTER (WHERE {c} = {f}_{c}) = 1 THEN min(item) FILTER (WHERE {c} = {f}_{c}) END"
_M = f"""{roles.SCENES_SQL}, {roles.SAMPLES_SQL}, m AS (SELECT scene, phase, frame, bool_or(model = 'A') AS has_rgb, bool_or(model = 'N') AS has_depth, bool_or(model = 'R') AS has_mask FROM samples GROUP BY ALL),
    f AS (SELECT scene, phase, frame, tier, has_rgb, has_depth, has_mask, format('scene_{{:05d}}/{{}}/{{:06d}}.png', scene, phase, frame) AS path FROM m LEFT JOIN scenes USING (scene) WHERE has_rgb AND has_depth AND has_mask)"""
_spin = lambda text: f"CAST(('0x' || substr(sha256({text}), 1, 12)) AS BIGINT)"
ORACLE_SQL = {
    "attr_unique_owner": f"WITH {_A} SELECT frame, attribute, value, min(item) AS item FROM a GROUP BY ALL HAVING count(DISTINCT item) = 1",
    "attr_composition": f"WITH {_O} SELECT frame, p_brand AS brand, size_class AS size, min(item) AS item FROM o GROUP BY ALL HAVING count(DISTINCT item) = 1",
    "attr_count": f"WITH {_O} SELECT frame, p_brand AS value, count(DISTINCT item) AS n FROM o GROUP BY ALL HAVING count(DISTINCT item) >= 2",
    "attr_odd_one_out": f"""WITH {_O}, t AS (SELECT frame, count(DISTINCT item) AS total FROM o GROUP BY frame), s AS (SELECT frame, size_class AS value, count(DISTINCT item) AS n FROM o GROUP BY ALL)
        SELECT s.frame, s.value, o.item FROM s JOIN t USING (frame) JOIN o USING (frame) WHERE n = total - 1 AND n >= 2 AND o.size_class <> s.value""",
    "attr_absent": f"WITH {_O}, f AS (SELECT DISTINCT frame FROM o), v AS (SELECT DISTINCT size_class AS value FROM o) SELECT frame, value FROM f, v EXCEPT SELECT frame, size_class FROM o",
    "synonym_yes": f"""WITH {_O}, p AS (SELECT DISTINCT frame, item, p_type AS alias FROM o WHERE p_type <> p_brand)
        SELECT frame, item, alias FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.frame = p.frame AND o.item <> p.item AND (o.p_type = p.alias OR o.p_brand = p.alias))""",
    "spatial_pairs": f"""WITH {_P} SELECT a.frame, a.item AS a, b.item AS b, 'left_of' AS relation FROM p a JOIN p b ON a.frame = b.frame AND a.item <> b.item AND b.x - a.x >= CAST(6.4 AS DOUBLE)
        UNION ALL SELECT a.frame, a.item, b.item, 'above' FROM p a JOIN p b ON a.frame = b.frame AND a.item <> b.item AND b.y - a.y >= CAST(4.8 AS DOUBLE)""",
    "spatial_extremes": f"""WITH {_P}, w AS (SELECT *, min(x) OVER f AS min_x, max(x) OVER f AS max_x, min(y) OVER f AS min_y, max(area) OVER f AS max_area, min(depth) OVER f AS min_depth FROM p WINDOW f AS (PARTITION BY frame))
        SELECT frame, {_ext("x", "min")} AS leftmost, {_ext("x", "max")} AS rightmost, {_ext("y", "min")} AS topmost, {_ext("area", "max")} AS largest, {_ext("depth", "min")} AS closest FROM w GROUP BY frame""",
    "spatial_farthest": f"""WITH {_P}, d AS (SELECT a.frame, a.item AS a, b.item AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, (a.area - b.area) * (a.area - b.area) AS z FROM p a JOIN p b ON a.frame = b.frame AND a.item < b.item),
        r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY d2 DESC, a DESC, b DESC) AS k2, row_number() OVER (PARTITION BY frame ORDER BY d2 + z DESC, a DESC, b DESC) AS k3 FROM d)
        SELECT frame, a, b FROM r WHERE k2 = 1 AND k3 = 1""",
    "incontext_reference": f"""WITH {_O}, t AS (SELECT DISTINCT frame, item, p_brand AS value FROM o),
        s AS (SELECT frame, value FROM t GROUP BY ALL HAVING count(DISTINCT item) > 1), clear AS (SELECT t.* FROM t LEFT JOIN s USING (frame, value) WHERE s.frame IS NULL),
        c AS (SELECT p_partkey AS reference, p_brand AS value FROM part),
        r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY sha256('ref:' || value || chr(31) || reference), reference) - 1 AS place, count(*) OVER (PARTITION BY value) AS size FROM c),
        n AS (SELECT frame, count(DISTINCT item) AS objects FROM t GROUP BY frame),
        a AS (SELECT clear.*, objects, size, {_spin("'ref:' || frame || chr(31) || item || chr(31) || value")} AS start
            FROM clear JOIN n USING (frame) JOIN (SELECT DISTINCT value, size FROM r) USING (value)),
        p AS (SELECT *, unnest(range(least(objects + 1, size))) AS step FROM a),
        f AS (SELECT p.frame, p.item, p.value, step, reference FROM p JOIN r ON r.value = p.value AND r.place = (p.start + p.step) % p.size)
        SELECT f.frame, f.item, f.value, arg_min(f.reference, step) AS reference FROM f LEFT JOIN t ON t.frame = f.frame AND t.item = f.reference WHERE t.frame IS NULL GROUP BY ALL""",
    "mcq_options": f"""WITH q AS (SELECT p_partkey AS q, p_type AS answer FROM part),
        pool AS (SELECT o, row_number() OVER (ORDER BY sha256('opt:' || o), o) - 1 AS place, count(*) OVER () AS size FROM (SELECT DISTINCT p_type AS o FROM part)),
        p AS (SELECT q, answer, size, {_spin("'opt:' || q")} AS start, unnest(range(least(4, size))) AS step FROM q, (SELECT DISTINCT size FROM pool)),
        w AS (SELECT q, answer, o, row_number() OVER (PARTITION BY q ORDER BY step) AS k FROM p JOIN pool ON place = (start + step) % p.size WHERE o <> answer),
        e AS (SELECT q, answer, o FROM w WHERE k <= 3 UNION ALL SELECT q, answer, answer FROM q), m AS (SELECT q, answer, list(o ORDER BY sha256('opt:' || q || ':' || o)) AS os FROM e GROUP BY ALL)
        SELECT q, answer, array_to_string(os, '|') AS options, substr('ABCDEFGH', CAST(list_position(os, answer) AS INT), 1) AS letter FROM m WHERE len(os) = 4""",
    "mcq_accuracy": """WITH l AS (SELECT doc_id, quality, lang, source, CASE WHEN doc_id % 4 <> 0 THEN CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END END AS given FROM labels JOIN documents USING (doc_id))
        SELECT lang, source, round(avg(CASE WHEN given IS NOT DISTINCT FROM quality THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (WHERE given IS NULL) AS missing, count(*) AS n FROM l GROUP BY GROUPING SETS ((), (lang), (source))""",
    "semantic_dedup": """WITH k AS (SELECT event_id, CASE WHEN event_type = 'click' THEN concat_ws(chr(31), event_type, user_id, strftime(ts, '%Y-%m-%d %H:%M')) WHEN event_type IN ('view', 'purchase', 'signup', 'scroll')
        THEN concat_ws(chr(31), event_type, user_id, json_extract_string(props, '$.k')) END AS key FROM events) SELECT sha256(key) AS key, min(event_id) AS kept, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY k.key HAVING count(*) > 1""",
    "drop_reasons": """SELECT l_linestatus AS type, CASE WHEN l_quantity < 3 THEN 'fragment' WHEN l_discount = 0 THEN 'no_depth' WHEN l_returnflag = 'R' THEN 'ambiguous' END AS reason, count(*) AS n FROM lineitem
        WHERE l_quantity < 3 OR l_discount = 0 OR l_returnflag = 'R' GROUP BY ALL""",
    "frame_manifest": f"WITH {_M} SELECT * FROM f",
    "clip_entries": f"WITH {_M} SELECT scene, phase, string_agg(CAST(frame AS VARCHAR), ',' ORDER BY frame) AS frames, count(*) AS n FROM f GROUP BY scene, phase HAVING count(*) >= 4",
    "shard_flags": f"""WITH {roles.SAMPLES_SQL}, s AS (SELECT scene, min(sample) FILTER (WHERE model = 'A') AS a, min(sample) FILTER (WHERE model = 'N') AS n, min(sample) FILTER (WHERE model = 'R') AS r FROM samples GROUP BY scene)
        SELECT scene, a AS shard_a, n AS shard_n, r AS shard_r, a IS NULL OR n IS NULL OR r IS NULL AS incomplete FROM s""",
    "allow_patterns": """SELECT format('scene_{:03d}', n_nationkey) || '/' || k AS pattern FROM nation, (VALUES ('rgb/*'), ('depth/*'), ('masks/v2/*'), ('pose/*')) AS t(k)""",
    "row_count_expectations": """SELECT 'region' AS "table", count(*) AS rows, CAST(5 AS BIGINT) AS expected, count(*) = 5 AS ok FROM region UNION ALL SELECT 'nation', count(*), 25, count(*) = 25 FROM nation
        UNION ALL SELECT 'customer', count(*), 150, count(*) = 150 FROM customer UNION ALL SELECT 'orders', count(*), NULL, false FROM orders""",
    "dup_keys": "SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1",
    "unit_status": """WITH u AS (SELECT l_suppkey, bool_or(l_shipdate >= TIMESTAMP '1998-10-01') AS late, bool_or(l_quantity <= 0) AS quantity, bool_or(l_extendedprice < 950) AS cheap, count(*) AS n FROM lineitem GROUP BY l_suppkey)
        SELECT l_suppkey, CASE WHEN late OR quantity THEN 'error' WHEN cheap THEN 'warning' ELSE 'ok' END AS status, n, concat_ws(',', CASE WHEN late THEN 'late' END, CASE WHEN quantity THEN 'quantity' END) AS errors, concat_ws(',', CASE WHEN cheap THEN 'cheap' END) AS warnings FROM u""",
    "completeness_gaps": "SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 5 = 0 THEN 'p_name' END, CASE WHEN p_partkey % 7 = 0 THEN 'p_type' END) AS gaps FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0",
    "checksum_status": "SELECT item_id AS k, CASE WHEN item_id % 9 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM benchmark UNION ALL SELECT item_id + 1000, 'missing' FROM benchmark",
    "split_integrity": f"""WITH {roles.SAMPLES_SQL}, c AS (SELECT scene, phase, arg_min(model, struct_pack(a := sample, b := model)) AS tier FROM samples GROUP BY scene, phase)
        SELECT scene, count(DISTINCT tier) AS tiers, count(*) AS cells FROM c GROUP BY scene HAVING count(DISTINCT tier) <> 1 OR count(*) <> 3""",
    "orphan_rows": "SELECT l_partkey + 3 AS k, count(*) AS n FROM lineitem WHERE l_partkey + 3 NOT IN (SELECT p_partkey FROM part) GROUP BY 1",
    "not_finite": "SELECT c_custkey, 'c_acctbal' AS columns FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 13 = 0",
    "sequence_summary": """SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS first, max(l_linenumber) AS last, max(l_linenumber) - min(l_linenumber) + 1 - count(DISTINCT l_linenumber) AS missing,
        count(*) - count(DISTINCT l_linenumber) AS duplicate FROM lineitem GROUP BY l_orderkey""",
}
