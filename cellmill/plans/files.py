"""Queries of what is written and read back: decoded bytes, published versions, resumable work. With equal SQL."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cellmill.operators import identity as N
from cellmill.operators import lookups as K
from cellmill.session import settle, shared_dir
from cellmill.sources import decode as B
from cellmill.sources import shards as T
from cellmill.sources.publish import Files, Published
from cellmill.sources.tables import table
from cellmill.streaming.ledger import Ledger


def decoded_arrays(spark, sf):
    """Vectors as NPY bytes and as 16-bit depth images in millimetres, decoded; of every tenth the last bytes are torn off."""
    def encode(batches):
        for batch in batches:
            rows = [np.array(v, np.float32) for v in batch.column("embedding").to_pylist()]
            files = [B.npy(v) for v in rows]
            images = [B.encoded_png(np.rint(1000 * (2 + 4 * v.astype(np.float64))).clip(0, 65535).astype(np.uint16).reshape(8, 8)) for v in rows]
            torn = [i is not None and i % 10 == 0 for i in batch.column("vec_id").to_pylist()]
            cut = lambda files: pa.array([f[:-9] if t else f for f, t in zip(files, torn)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), cut(files), cut(images)], names=["vec_id", "npy", "png"])

    e = table(spark, sf, "embeddings").select("vec_id", "embedding").filter("embedding IS NOT NULL")
    files = e.mapInArrow(encode, "vec_id bigint, npy binary, png binary")
    read = files.select("vec_id", B.decode(F.col("npy"), "array").alias("a"), B.decode(F.col("png"), "depth").alias("d"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return read.select("vec_id", F.size("a.shape").alias("dims"), F.round(total("a.values"), 6).alias("total"), F.round(total("d.values"), 6).alias("millimetres"), F.col("a.error").isNotNull().alias("npy_failed"), F.col("d.error").isNotNull().alias("png_failed"))


def published_version(spark, sf):
    """Parts by brand, published, then corrected and published again; what a reader sees, and the fields beside it."""
    place = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    brands = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"))
    published = Published(spark, place)
    published.publish(brands, {"owner": "parts", "rows": "all"})
    published.publish(published.read().filter("size % 2 = 0"), {"rows": "even"})
    beside = published.sidecar()
    seen = settle(published.read().withColumn("owner", F.lit(beside["owner"])).withColumn("rows", F.lit(beside["rows"])).withColumn("version", F.lit(published.number())))
    published.files.delete(place)
    return seen


def resumed_work(spark, sf):
    """Orders worked through in three runs, the second of which is sent twice; some fail at first, some always. An order fails as often as its number has the
    factor five (at most four times)."""
    place = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    ledger = Ledger(spark, place, "o_orderkey", "bigint", buckets=32)
    orders = table(spark, sf, "orders").select("o_orderkey")
    fails = sum(((F.col("o_orderkey") % 5**k == 0).cast("int") for k in range(1, 5)), F.lit(0))

    def work(items):
        tried = ledger.known(items)
        left = items.join(tried, F.col("o_orderkey") == F.col("known"), "left")
        return settle(left.select("o_orderkey", (F.coalesce("attempts", F.lit(0)) >= fails).alias("ok"), F.lit(None).cast("string").alias("detail")))

    for run, part in enumerate(("o_orderkey % 3 = 0", "o_orderkey % 3 <> 1", "true", "true", "true")):
        ledger.run(orders.filter(part), work, f"run-{run}")
        if run == 1:
            ledger.run(orders.filter(part), work, f"run-{run}")
    states = settle(ledger.states().drop("detail"))
    Files(spark, place).delete(place)
    return states


def packed_pages(spark, sf):
    """Pages and their addresses packed into tar shards and read back: those that have both, by the manifest of the shards."""
    place = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    file = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.col(text).alias("text"))
    both = F.explode(F.array(file("page.html", "html"), file("link.txt", "url")))
    members = table(spark, sf, "pages").select("page_id", both.alias("m")).filter("m.text IS NOT NULL")
    T.pack(members.select(F.concat_ws(".", "page_id", "m.kind").alias("member"), F.col("m.text").cast("binary").alias("data")), place)
    whole = T.samples(T.read(spark, place, payload=False), ["page", "link"]).select("sample", F.explode(F.array("page", "link")).alias("at"))
    read = T.read(spark, place).join(whole.select("sample", "at.shard", "at.member"), ["shard", "member"])
    text = lambda kind: F.min(F.when(F.col("member").endswith(kind), F.col("data")))
    pages = read.groupBy("sample").agg(text(".html").alias("html"), text(".txt").alias("url"))
    found = settle(pages.select(F.col("sample").cast("bigint").alias("page_id"), F.sha2("html", 256).alias("html_sha256"), F.octet_length("html").cast("bigint").alias("html_bytes"), F.col("url").cast("string").alias("url")))
    Files(spark, place).delete(place)
    return found


def scoped_frames(spark, sf):
    """Suppliers as frames of three families, then those with both modalities."""
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("scene_type"), (F.col("s_acctbal") > 0).alias("has_depth"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey") % 4 < 3).alias("has_mask"))
    return K.scoped(s, [0, 2, 3], ["has_depth", "has_mask"]).select("s_suppkey", "scene_type")


def picked_metrics(spark, sf):
    """Means of the numeric columns that are registered metrics, whichever a table has."""
    lines = table(spark, sf, "lineitem")
    names = K.metric_columns(lines, {"l_tax", "l_quantity", "l_discount", "l_shipmode", "absent"})
    means = lines.agg(*[F.round(F.avg(n), 6).alias(n) for n in names])
    return means.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("mean")) for n in names])).alias("m")).select("m.*")


def cell_log_rows(spark, sf):
    """A cell log as rows of an analysis."""
    p = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("price"), F.count(F.lit(1)).alias("n"))
    log = p.select(F.col("p_brand").alias("scene_id"), F.col("p_size").alias("phase"), F.when(F.col("p_size") > 25, "hard").alias("difficulty"), F.round("price", 4).alias("metric:absrel"), F.col("n").alias("metric:frames"))
    return K.analysis_rows(log)


def border_coherence(spark, sf):
    """Borders of masks (parts of a vector above zero) against borders of depth, by label."""
    e = table(spark, sf, "embeddings").filter("label IS NOT NULL AND embedding IS NOT NULL")
    frames = e.select("label", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("mask"), F.transform("embedding", lambda x: 2 + 4 * x.cast("double")).alias("depth"))
    scores = N.border_coherence(frames, ["label"], (8, 8), 0.5, 1)
    return scores.select("label", "frames", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "coherence")])


QUERIES = {f.__name__: f for f in (decoded_arrays, published_version, resumed_work, packed_pages, scoped_frames, picked_metrics, cell_log_rows, border_coherence)}
ORACLE_SQL: dict[str, str] = {
    "decoded_arrays": """WITH e AS (SELECT vec_id, vec_id % 10 = 0 AS torn, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL)
        SELECT vec_id, CASE WHEN torn THEN NULL ELSE 1 END AS dims, CASE WHEN NOT torn THEN round(list_sum(v), 6) END AS total,
            CASE WHEN NOT torn THEN round(list_sum(list_transform(v, lambda x: least(greatest(round_even(1000 * (2 + 4 * x), 0), 0), 65535))), 6) END AS millimetres, torn AS npy_failed, torn AS png_failed FROM e""",
    "published_version": """SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size, 'parts' AS owner, 'even' AS rows, 2 AS version FROM part GROUP BY p_brand HAVING sum(p_size) % 2 = 0""",
    "resumed_work": """WITH o AS (
            SELECT o_orderkey, (o_orderkey % 5 = 0)::INT + (o_orderkey % 25 = 0)::INT + (o_orderkey % 125 = 0)::INT + (o_orderkey % 625 = 0)::INT AS fails,
                CASE o_orderkey % 3 WHEN 0 THEN 5 WHEN 2 THEN 4 ELSE 3 END AS turns FROM orders)
        SELECT o_orderkey, CASE WHEN fails < least(turns, 3) THEN 'done' ELSE 'failed' END AS state, CAST(least(fails + 1, turns, 3) AS INT) AS attempts FROM o""",
    "packed_pages": "SELECT page_id, sha256(html) AS html_sha256, octet_length(encode(html)) AS html_bytes, url FROM pages WHERE html IS NOT NULL AND url IS NOT NULL",
    "scoped_frames": """SELECT s_suppkey, s_nationkey % 5 AS scene_type FROM supplier WHERE s_nationkey % 5 IN (0, 2, 3) AND s_acctbal > 0 AND s_suppkey % 4 IN (1, 2)""",
    "picked_metrics": """SELECT 'l_quantity' AS metric, round(avg(l_quantity), 6) AS mean FROM lineitem UNION ALL SELECT 'l_discount', round(avg(l_discount), 6) FROM lineitem
        UNION ALL SELECT 'l_tax', round(avg(l_tax), 6) FROM lineitem""",
    "cell_log_rows": """SELECT p_brand AS scene, p_size AS phase, CASE WHEN p_size > 25 THEN 'hard' END AS difficulty, p_brand || '_' || p_size AS id, round(avg(p_retailprice), 4) AS absrel, count(*) AS frames
        FROM part GROUP BY p_brand, p_size""",
}
