"""Mixing, Merkle manifests and hard negatives against plain loops and their SQL, on odd rows too."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmill.llm import merkle, mixing, negatives
from cellmill.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    rows = [(i, f"word{i % 7} " * (i % 23) + "\n" * (i % 3), "en", f"s{i % 4}" if i % 5 else "s0", i % 11) for i in range(300)]
    rows += [(None, "a b c", "en", None, None), (None, "a b c", "en", None, None), (None, None, None, "s1", 3), (300, None, "en", None, 0), (300, "", "de", "", 0), (301, "é\n\n中 文", None, "\U0001f600", 5), (302, "one", "en", "￮", 1)]
    rows += [(777, "same text\nagain", "en", "copies", 2)] * 120 + [(None, "no id here", "en", "copies", 2)] * 90
    return spark.createDataFrame(rows, DOCS)


def against_sql(spark, tmp_path, name, **tables):
    duck = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(str(tmp_path / f"{t}.parquet"))
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert sorted(got.columns) == sorted(columns)
    rows = plain(tuple(r) for r in got.select(*columns).collect())
    assert rows == plain(want.fetchall())
    return [dict(zip(columns, r)) for r in rows]


# --- mixing

def filled(sizes, weights, wanted, epochs):
    """Clamps, reshares the excess, and again until none is above."""
    target, full = {}, set()
    while True:
        free = [s for s in sizes if s not in full]
        left = wanted - sum(epochs * sizes[s] for s in full)
        total = sum(weights[s] for s in free)
        target = {s: epochs * sizes[s] if s in full else left * weights[s] / total if total else 0.0 for s in sizes}
        over = {s for s in free if target[s] > epochs * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_water_filling_equals_repeated_clamping(spark, seed):
    draw = random.Random(seed)
    sizes = {f"s{i}": draw.choice([0, 1, 5, 100, 10_000, draw.randrange(10**9)]) for i in range(40)}
    weights = {s: draw.choice([0, 1, 2, 3, 50]) for s in sizes}
    share = draw.choice([0.1, 0.7, 1.5])
    rows = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source string, size long, weight long")
    got = {r.source: r.target for r in mixing.water_fill(rows, share).collect()}
    heavy = {s: n for s, n in sizes.items() if weights[s]}
    want = {s: 0.0 for s in sizes} | filled(heavy, weights, share * sum(sizes.values()), 2)
    assert got == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_mix_on_odd_rows(spark, tmp_path):
    docs = documents(spark)
    rows = against_sql(spark, tmp_path, "op11_mixing", documents=docs)
    assert len(rows) == docs.count()
    sums = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        target, taken = sums.get(r["source"], (0, 0))
        sums[r["source"]] = r["target"], taken + r["taken"]
    for source, (target, taken) in sums.items():
        assert abs(target - taken) <= (120 if source == "copies" else 1), source  # equal rows share what is left
    again = QUERIES["op11_mixing"](spark.newSession(), str(tmp_path)).repartition(3)
    assert sorted(map(str, again.collect())) == sorted(map(str, QUERIES["op11_mixing"](spark, str(tmp_path)).collect()))


def test_the_mix_itself_has_the_words(spark):
    docs = documents(spark).withColumn("draw", F.lit(1)).withColumn("extra", F.lit(2)).withColumn("size", F.lit(3))
    mixed = mixing.mix(docs, (3, 1, 2), 1.3)
    by_source = lambda df, n: {r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(n).alias("n")).collect() if r["n"]}
    sample = mixing.sample(docs, (3, 1, 2), 1.3)
    assert sample.schema["doc"].dataType.names == docs.columns
    assert by_source(sample.select("doc.source", mixing.words(F.col("doc.text")).alias("w")), "w") == by_source(mixed, "taken")
    assert sample.groupBy("doc.doc_id", "doc.source").agg(F.max("repetition").alias("r")).filter("r > 1").count() == 0


def test_mix_plan_is_native(spark):
    plan = mixing.mix(documents(spark), (3, 1, 2), 1.5)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


# --- Merkle manifests

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    """(left siblings, right siblings) level by level."""
    out = []
    for nodes in levels[:-1]:
        run = at // 3 * 3
        out.append((nodes[run:at], nodes[at + 1 : run + 3]))
        at //= 3
    return out


def slow_manifest(docs):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by_source = {}
    for d in docs:
        leaf = sha(*map(field, (d.doc_id, d.source, d.lang, d.n_chars, d.text)))
        cut = d.doc_id is not None and zlib.crc32(str(d.doc_id).encode()) % 2 == 0 and d.text is not None
        other = sha(*map(field, (d.doc_id, d.source, d.lang, d.n_chars, d.text.replace("\n", "")))) if cut else leaf
        by_source.setdefault(d.source, []).append((d.doc_id is not None, d.doc_id or 0, leaf, other, d.doc_id))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([r[2] for r in sorted(by_source[s])]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    root, out = top[-1][0], []
    for k, s in enumerate(sources):
        for at, (_, _, leaf, other, doc_id) in enumerate(sorted(by_source[s])):
            path = siblings(trees[s], at) + siblings(top, k)
            node = other
            for a, b in path:
                node = sha(*a, node, *b)
            out.append((doc_id, leaf, trees[s][-1][0], root, sha(*[x for a, b in path for x in a + b]), node, node == root))
    return sorted(out, key=str)


def test_manifest_on_odd_rows(spark, tmp_path):
    docs = documents(spark)
    rows = against_sql(spark, tmp_path, "op12_merkle", documents=docs)
    names = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    assert sorted((tuple(r[n] for n in names) for r in rows), key=str) == slow_manifest(docs.collect())
    assert {r["verified"] for r in rows} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 82, 83])
def test_superblocks_of_any_height_agree(spark, n):
    leaves = spark.range(n).select("id", F.lit("one").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit(None).cast("string").alias("tampered"))
    levels = tree([sha(str(i)) for i in range(n)])
    for height in (1, 2):
        got = {r.id: r for r in merkle.manifest(leaves, levels=height).collect()}
        assert len(got) == n and {r.root for r in got.values()} == {levels[-1][0]} == {r.folded_root for r in got.values()}
        assert all(got[i].proof_sha256 == sha(*[x for a, b in siblings(levels, i) for x in a + b]) for i in range(n))


def test_many_sources_are_reduced_by_rounds(spark):
    leaves = spark.range(40).select("id", F.format_string("s%02d", "id").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit(None).cast("string").alias("tampered"))
    levels = tree([sha(str(i)) for i in range(40)])
    got = merkle.manifest(leaves, levels=2).collect()
    assert {(r.root, r.folded_root) for r in got} == {(levels[-1][0],) * 2} and all(r.leaf == r.subroot for r in got)


# --- hard negatives

def slow_negatives(rows, block=None):
    used = []
    for r in rows:
        if r.label is None or r.embedding is None or any(x is None or not np.isfinite(x) for x in r.embedding):
            continue
        label = (r.label + 1) % 10 if r.vec_id is not None and r.vec_id % 7 == 0 else r.label
        used.append((r.vec_id, label, [int(np.floor(256 * float(x))) for x in r.embedding]))
    out = []
    for a, (anchor, label, v) in enumerate(used):
        if anchor is None or anchor % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), other is None, other or 0, b, other, its) for b, (other, its, w) in enumerate(used) if b != a and len(v) == len(w)]
        scored.sort(key=lambda s: s[:4])
        for score, _, _, _, positive, _ in [s for s in scored if s[5] == label][:5]:
            fit = [s for s in scored if s[5] != label and -30 * score <= -100 * s[0] <= -90 * score][:10]
            out += [(anchor, positive, k, s[4], -score, -s[0]) for k, s in enumerate(fit, 1)]
    return sorted(out, key=str)


def vectors(spark, n=400, width=6, labels=3, tiny=False):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in (draw.integers(-1, 3, width) / 256 if tiny else draw.normal(0.3, 0.6, width))], int(draw.integers(labels))) for i in range(n)]
    rows += [(None, [0.5] * width, 1), (None, [0.25] * width, None), (500, None, 1), (600, [0.1] * (width - 1) + [float("nan")], 1), (700, [0.1] * (width - 1) + [None], 1), (800, [], 1), (900, [], 2), (1000, [1.0], 1), (1100, [2.0], 2)]
    rows += [(100, [0.5] * width, 1)] * 3 + [(1200, [float("inf")] * width, 0), (1300, [-0.5] * width, 2)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1)).withColumn("row", F.lit(2))


@pytest.mark.parametrize("tiny", [False, True])  # tiny: many equal scores
def test_negatives_on_odd_rows(spark, tmp_path, tiny):
    rows = vectors(spark, tiny=tiny)
    got = against_sql(spark, tmp_path, "op13_negatives", embeddings=rows)
    names = "anchor_id positive_id rank negative_id positive_score negative_score".split()
    want = slow_negatives(rows.collect())
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == want and len(want) > 100


def test_blocks_change_nothing(spark):
    rows = vectors(spark).drop("id", "row")
    mined = lambda block: sorted(map(str, negatives.mine(rows, F.col("id") % 10 == 0, block=block).collect()))
    assert mined(7) == mined(65_536)


def test_scores_beyond_a_double(spark):
    assert negatives.scores(np.array([[2**40, 3]]), np.array([[2**20, 5]]))[0, 0] == 2**60 + 15
    assert negatives.scores(np.array([[2**62, 0]]), np.array([[2**62, 1], [-(2**62), 1]])).tolist() == [[2**63 - 1, -(2**63) + 1]]
    assert negatives.limits(-3) == (0, -3) and negatives.limits(7) == (3, 6)


@pytest.mark.parametrize("name", ["op11_mixing", "op12_merkle", "op13_negatives"])
def test_empty_tables(spark, tmp_path, name):
    documents(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    vectors(spark).limit(0).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
