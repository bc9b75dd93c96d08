"""The whole pipeline against plain loops: every stage by its rule, with none of the operators' code."""

import random
import shutil
import string

import corpus_pipeline
from cellmill.llm.queries import byte_bpe_path
from tests.llm.test_dedup import edited, slow_alike, slow_leaks, slow_repeats, substituted, union_find
from tests.llm.test_models import slow_quality

SF = "/root/testdata/sf0.001"
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    words = (text or "").translate(_LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def planted(rng, docs, items):
    """Rows beside the given ones: exact and near copies, passages that many texts share, benchmark items whole and with substitutions, awkward texts."""
    long = [r for r in docs if r.text and len(r.text.split()) >= 60]
    texts = [r.text for r in long[:6]]
    texts += [edited(rng, r.text, max(1, len(r.text.split()) // 60)) for r in long[:12] for _ in range(2)]
    passage = "The river rose over the lower fields before the first bell had rung that day. Nobody in the valley had seen so much water in forty years. They carried what they could up the hill. "
    texts += [f"{r.text.strip()} {passage}{rng.choice(long).text[:40].strip()} again." for r in long[12:24]]
    whole = [t.text for t in items if t.text and len(t.text.split()) >= 10]
    texts += [f"{r.text.strip()} {substituted(rng, rng.choice(whole), n)} So it ends." for r, n in zip(long[24:34], [0, 0, 1] * 4)]
    return texts + ["", " \n", "One short text.", "One short text.", "ends \x00 oddly \U0001f600 é."]


def slow_pipeline(spark, rows, labels, items):
    """{id: (token ids)} of the documents that stay, and how many each stage kept. rows: (id, text) with different ids."""
    from tokenizers import Tokenizer

    scores = slow_quality(rows, labels)
    assert min(abs(s - 0.3) for s in scores.values()) > 1e-4  # no score is so near the threshold that rounding decides
    good = [(i, t) for i, t in rows if scores[i] >= 0.3]
    sets = {i: shingles(t) for i, t in good}
    group = union_find([(a, b) for a in sets for b in sets if a < b and slow_alike(sets[a], sets[b])], sets)
    single = [(i, t) for i, t in good if group[i] == i]
    cut = slow_repeats(spark, single)
    left = [(i, cut[i, t][0]) for i, t in single]
    leaked = {i for i, _, _ in slow_leaks(left, items)}
    clean = [(i, t) for i, t in left if i not in leaked]
    library = Tokenizer.from_file(byte_bpe_path())
    library.no_padding()
    library.no_truncation()
    shortened = sum(cut[row][1] > 0 for row in single)
    return {i: library.encode(t, add_special_tokens=False).ids for i, t in clean}, (len(rows), len(good), len(single), shortened, len(clean))


def test_pipeline_against_plain_loops(spark, tmp_path):
    rng = random.Random(31)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own, items = docs.collect(), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    more = [(1_000_000 + k, t) for k, t in enumerate(planted(rng, own, items))]
    schema = docs.schema
    extra = [tuple({"doc_id": i, "text": t, "lang": "en", "source": "planted", "n_chars": len(t)}.get(c) for c in schema.names) for i, t in more]
    docs.unionByName(spark.createDataFrame(extra, schema)).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    want, kept = slow_pipeline(spark, [(r.doc_id, r.text) for r in own] + more, labels, [(r.item_id, r.text) for r in items])
    total, good, single, shortened, clean = kept
    assert total > good > single > clean > 0 and shortened > 5  # every stage has something to do
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == len({r.doc_id for r in got})
    assert {r.doc_id: r.ids for r in got} == want
    assert all(r.n_tokens == len(r.ids) for r in got)
