"""The queries of this subpackage, for the driver's entry module: name -> function of (spark, sf_dir), and SQL where it can express one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmill.llm import bpe, chat, decontaminate, embedding, lm, merkle, mixing, negatives, quality, simhash, substring, tokencounts, urls
from cellmill.llm.common import cut, shared_dir, table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted windows of every conversation and of one that consists of control strings."""
    control = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], rows.schema)
    formatted = chat.windows(rows.union(probe))
    own = F.slice(chat.read_turns(F.col("formatted")), F.col("n_repeated") + 1, F.col("n_new"))
    read = formatted.select(
        "conv", "section", "span",
        F.size(own).alias("n"),
        F.array_join(F.transform(own, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), "").alias("loss"),
        F.length("formatted").alias("chars"),
    )
    ordered = read.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("section", "span", "n", "turns", "loss", "chars"))).alias("w"))
    total = lambda field: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[field])
    text = lambda field: F.array_join(F.transform("w", lambda x: x[field]), "")
    return ordered.select(
        F.col("conv").alias("conv_id"), total("n").alias("n_turns"), F.sha2(text("turns"), 256).alias("turns_sha256"),
        F.length(text("loss")).cast("long").alias("loss_chars"), F.sha2(text("loss"), 256).alias("loss_sha256"), total("chars").alias("formatted_chars"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUALITY_THRESHOLD = 0.3


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.score(docs, weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_THRESHOLD).cast("int"))


#: The rules that this query is asked to judge by.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.lit(True).alias("contaminated"),
        F.col("start").cast("long").alias("start_token"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_equal").cast("long").alias("n_equal"),
    )


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), byte_bpe_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document that loses a repeated passage: what is left of it, and the documents that keep the passages."""
    changed, _ = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return changed.select(
        "doc.doc_id", F.col("repeats.sentences").cast("long").alias("n_sentences"), F.col("repeats.removed").cast("long").alias("n_removed"),
        F.col("repeats.sources").alias("source_doc_ids"), "repeats.text",
    )


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each document is like the texts of `benchmark` rather than the documents at large."""
    return lm.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents come in, labelled ones are counted anew by the second tokenizer, toxic ones
    go. The second batch is sent twice, as after a lost answer."""
    docs, text = table(spark, sf_dir, "documents"), F.col("text")
    counts = cut(docs.select("doc_id", "source", "lang", *[tokencounts.count_tokens(text, v).alias(v) for v in tokencounts.TOKENIZERS]))
    at = lambda version: tokencounts.key(F.col("source"), F.col("lang"), F.lit(version), F.col(f"`{version}`"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = cut(counts.join(labels, "doc_id"))
    rollup = tokencounts.Rollup(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    revised = labelled.select(F.lit("revise").alias("op"), at("words-1").alias("old"), at("words-2").alias("new"))
    rollup.commit("arrivals", counts.select(F.lit("insert").alias("op"), at("words-1").alias("new")))
    rollup.commit("recount", revised)
    rollup.commit("recount", revised)
    rollup.commit("removals", labelled.filter("toxic = 1").select(F.lit("delete").alias("op"), at("words-2").alias("old")))
    totals = cut(rollup.totals())
    rollup.remove()  # its folder was this query's own
    return totals.withColumnRenamed("version", "tokenizer_version").withColumnRenamed("docs", "n_docs").withColumnRenamed("tokens", "n_tokens")


#: Weights of the sources in turn, and words of the mix to words of the corpus.
MIX_CYCLE, MIX_SHARE = (3, 1, 2), 1.5


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_CYCLE, MIX_SHARE)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, proved against rows of which every second one may have lost its line ends."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in merkle.FIELDS]
    odd = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    tampered = F.when(odd, merkle.leaf(*fields[:-1], F.translate("text", "\n", "")))
    leaves = docs.select(F.col("doc_id").alias("id"), "source", merkle.leaf(*fields).alias("leaf"), tampered.alias("tampered"))
    return merkle.manifest(leaves).withColumnRenamed("id", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; labels of every seventh are wrong by one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", wrong), F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_urls": op4_urls,
    "op5_decontaminate": op5_decontaminate,
    "op6_bpe": op6_bpe,
    "op7_embedding": op7_embedding,
    "op8_substring": op8_substring,
    "op9_lm": op9_lm,
    "op10_tokencounts": op10_tokencounts,
    "op11_mixing": op11_mixing,
    "op12_merkle": op12_merkle,
    "op13_negatives": op13_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op4_urls": f"""
        WITH rules(rh, rp, rv) AS (VALUES {", ".join(map(str, URL_RULES))}),
        parsed AS (
            SELECT row_number() OVER () AS n, page_id,
                coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        fits AS (
            SELECT n, rh || rp AS rule, rv, row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC, length(rh) DESC, rv DESC) AS k
            FROM parsed, rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
        SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict
        FROM parsed LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
    """,
    "op10_tokencounts": r"""
        WITH counts AS (
            SELECT doc_id, source, lang,
                coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS one,
                coalesce(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]')), 0) AS two
            FROM documents),
        marks AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
        placed AS (
            SELECT source, lang, CASE WHEN marks.doc_id IS NULL THEN 'words-1' ELSE 'words-2' END AS tokenizer_version,
                CASE WHEN marks.doc_id IS NULL THEN one ELSE two END AS n
            FROM counts LEFT JOIN marks USING (doc_id) WHERE toxic IS NULL OR toxic <> 1)
        SELECT source, lang, tokenizer_version, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
        FROM placed GROUP BY source, lang, tokenizer_version
    """,
    "op11_mixing": f"""
        WITH sized AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 16) AS draw
            FROM documents),
        sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, {mixing.EPOCHS} * CAST(sum(size) AS BIGINT) AS cap,
                [{", ".join(map(str, MIX_CYCLE))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(MIX_CYCLE)} + 1] AS weight
            FROM sized GROUP BY source),
        sums AS (SELECT {MIX_SHARE} * sum(source_size) AS wanted, sum(weight) AS weights FROM sources),
        stood AS (
            SELECT *, coalesce(sum(cap) OVER before, 0) AS caps_before, coalesce(sum(weight) OVER before, 0) AS weights_before FROM sources, sums
            WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        judged AS (SELECT *, cap * (weights - weights_before) <= (wanted - caps_before) * weight AS filled FROM stood),
        levels AS (SELECT (max(wanted) - coalesce(sum(cap) FILTER (filled), 0)) / sum(weight) FILTER (NOT filled) AS level FROM judged),
        planned AS (
            SELECT source, source_size, CASE WHEN filled THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target FROM judged, levels),
        whole AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM planned),
        parts AS (SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS extra FROM whole),
        alike AS (SELECT source, draw, doc_id, size, count(*) AS n FROM sized GROUP BY ALL),
        ordered AS (
            SELECT *, coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM alike),
        shares AS (
            SELECT o.source, o.draw, o.doc_id, o.size, p.source_size, p.target,
                whole * o.size + CASE WHEN before + o.size * n <= extra THEN o.size WHEN before >= extra THEN 0 ELSE CAST(extra - before AS BIGINT) // n END AS taken
            FROM ordered o JOIN parts p ON o.source IS NOT DISTINCT FROM p.source)
        SELECT s.doc_id, s.source, s.size, source_size, target, CAST(taken AS BIGINT) AS taken
        FROM sized s JOIN shares h ON s.source IS NOT DISTINCT FROM h.source AND s.draw = h.draw AND s.doc_id IS NOT DISTINCT FROM h.doc_id AND s.size = h.size
    """,
    "op12_merkle": r"""
        WITH RECURSIVE rows AS (
            SELECT doc_id, source, text IS NOT NULL AND contains(text, chr(10)) AS cuttable, text,
                coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
            FROM documents),
        leaves AS (
            SELECT row_number() OVER () AS r, doc_id, source, cuttable, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS other
            FROM rows),
        crc_table(i, c) AS (
            SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) FROM range(256) t(i)),
        crcs(id, pos, c) AS (
            SELECT id, 1, 4294967295 FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id IS NOT NULL)
            UNION ALL SELECT id, pos + 1, xor(crc_table.c, crcs.c >> 8) FROM crcs, crc_table WHERE pos <= length(id) AND i = xor(crcs.c & 255, ascii(id[pos]))),
        hit AS (SELECT CAST(id AS BIGINT) AS id FROM crcs WHERE pos = length(id) + 1 AND xor(c, 4294967295) % 2 = 0),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves),
        nodes(source, lvl, idx, n, h) AS (
            SELECT source, 0, idx, n, leaf FROM placed
            UNION ALL SELECT source, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY source, lvl, idx // 3, n),
        subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS sid, count(*) OVER () AS ns FROM nodes WHERE n = 1),
        upper_nodes(lvl, idx, n, h) AS (
            SELECT 0, sid, ns, subroot FROM subroots
            UNION ALL SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM upper_nodes WHERE n > 1 GROUP BY lvl, idx // 3, n),
        low AS (
            SELECT p.r, d.lvl, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx < d.idx), '') AS lefts, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx > d.idx), '') AS rights
            FROM placed p JOIN nodes d ON d.source IS NOT DISTINCT FROM p.source AND d.n > 1 AND d.idx = p.idx // CAST(pow(3, d.lvl) AS BIGINT)
            JOIN nodes s ON s.source IS NOT DISTINCT FROM p.source AND s.lvl = d.lvl AND s.idx // 3 = d.idx // 3 GROUP BY p.r, d.lvl),
        high AS (
            SELECT q.source, d.lvl, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx < d.idx), '') AS lefts, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx > d.idx), '') AS rights
            FROM subroots q JOIN upper_nodes d ON d.n > 1 AND d.idx = q.sid // CAST(pow(3, d.lvl) AS BIGINT)
            JOIN upper_nodes s ON s.lvl = d.lvl AND s.idx // 3 = d.idx // 3 GROUP BY q.source, d.lvl),
        steps AS (
            SELECT r, lvl, lefts, rights FROM low
            UNION ALL SELECT p.r, 1000 + h.lvl, h.lefts, h.rights FROM placed p JOIN high h ON h.source IS NOT DISTINCT FROM p.source),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lvl) AS k FROM steps),
        folded(r, k, h) AS (
            SELECT r, 0, CASE WHEN cuttable AND doc_id IN (SELECT id FROM hit) THEN other ELSE leaf END FROM placed
            UNION ALL SELECT f.r, f.k + 1, sha256(s.lefts || f.h || s.rights) FROM folded f JOIN numbered s ON s.r = f.r AND s.k = f.k + 1),
        proofs AS (SELECT r, string_agg(lefts || rights, '' ORDER BY k) AS siblings, max(k) AS k FROM numbered GROUP BY r),
        root AS (SELECT h AS root FROM upper_nodes WHERE n = 1)
        SELECT p.doc_id, p.leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
        FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN proofs x ON x.r = p.r JOIN folded f ON f.r = p.r AND f.k = coalesce(x.k, 0), root
    """,
    "op13_negatives": """
        WITH raw AS (SELECT row_number() OVER () AS r, vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings),
        rows AS (
            SELECT r, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM raw
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        scored AS (
            SELECT a.r, a.vec_id AS anchor_id, a.label AS anchor_label, b.r AS other, b.vec_id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)),
        positives AS (
            SELECT r, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) AS p FROM scored WHERE label = anchor_label),
        fits AS (
            SELECT s.r, anchor_id, p, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
                row_number() OVER (PARTITION BY s.r, p ORDER BY score DESC, vec_id, other) AS rank
            FROM scored s JOIN positives q ON s.r = q.r AND p <= 5 AND s.label <> anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM fits WHERE rank <= 10
    """,
}
