import hashlib
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellmill.llm import chat, urls
from cellmill.llm.queries import URL_RULES

CONV = "conv_id long, turn long, role string, text string, formatted string, span int"


def chat_tokens(text):
    """The rule of estimated_tokens for texts without marks or letters of scripts without spaces; others count more, so it's a bound."""
    return len(re.findall(r"[A-Za-z]{1,4}|[^A-Za-z\s]", text))


def read(spark, rows, **how):
    df = chat.windows(spark.createDataFrame([(*r, "x", 1) for r in rows], CONV), **how)
    out = df.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("masked", chat.read_loss(F.col("formatted"), F.col("loss")))
    return sorted(out.collect(), key=lambda r: (r.conv is not None, r.conv, r.section, r.span))


def test_escape_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\|end|>", "<<|sep|>>", "plain \\ [x]", "", "<|start|>a<|sep|>b<|end|>", "[[INST]", "<\\/s>\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("u", chat.unescape(F.col("e")))
    for r in df.collect():
        assert r.u == r.t
        assert not any(c in r.e for c in ("<|start|>", "<|sep|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]"))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", None, "tool"]), st.text("ab<>|[]/\\sINST|end ", max_size=30) | st.none()), min_size=1, max_size=30), st.integers(5, 60))
def test_windows_hold_each_turn_once(spark, turns, budget):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)]
    got = read(spark, rows, budget=budget, history=budget // 3)
    new = [(t.role, t.text) for w in got for t in w.turns[w.n_repeated :]]
    assert new == [(r or "", t or "") for _, _, r, t in rows]
    assert [x for w in got for x in w.masked] == [t or "" for _, _, r, t in rows if r == "assistant"]
    systems = [(r, t or "") for _, _, r, t in rows if r == "system"]
    for w in got:
        assert len(w.turns) == w.n_repeated + w.n_new
        if systems and 2 * (chat_tokens(systems[0][1]) + chat.TURN_MARKS) <= budget:
            assert systems[0] in [(t.role, t.text) for t in w.turns]
        assert w.n_tokens <= budget or w.n_new == 1


def slow_windows(rows, budget, history):
    """The windows of one conversation by a plain loop: [(turns, number of repeated ones)]. rows: (turn, role, text)."""
    turns = sorted(((-1 if n is None else n, r or "", t or "") for n, r, t in rows))
    tokens = [sum(-(-len(w) // 4) for w in t.split()) + chat.TURN_MARKS for _, _, t in turns]
    before = [sum(tokens[:i]) for i in range(len(turns))]
    system = next((i for i, t in enumerate(turns) if t[1] == "system"), None)
    if system is not None and 2 * tokens[system] > budget:
        system = None
    room = max(1, budget - history - (tokens[system] if system is not None else 0))
    spans = []
    for i in range(len(turns)):
        first = spans[-1][0] if spans else 0
        if not spans or before[i] + tokens[i] - before[first] > room:
            spans.append([])
        spans[-1].append(i)
    out = []
    for span in spans:
        repeated = [i for i in range(span[0]) if before[span[0]] - before[i] <= history and i != system]
        if system is not None and system not in span:
            repeated.insert(0, system)
        out.append(([turns[i][1:] for i in repeated + span], len(repeated)))
    return out


@pytest.mark.parametrize("sections", [5, 2])
@pytest.mark.parametrize("kind", ["short", "sparse", "null", "repeated", "long", "system", "endless"])
def test_windows_against_brute_force(spark, monkeypatch, kind, sections):
    monkeypatch.setattr(chat, "SECTION_WINDOWS", sections)
    rng = random.Random(kind)
    say = lambda: " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 40) if kind != "endless" or rng.random() < 0.9 else rng.choice([300, 2500])))
    number = {"short": lambda i: i, "sparse": lambda i: 100 * i, "null": lambda i: None, "repeated": lambda i: i // 50, "long": lambda i: i, "system": lambda i: i, "endless": lambda i: i}[kind]
    rows = [(number(i), rng.choice(["user", "assistant"]), say()) for i in range({"short": 130, "long": 1000}.get(kind, 200))]
    if kind in ("system", "repeated"):
        rows += [(60, "system", "be brief"), (3, "system", "be kind")]
    got = read(spark, [(1, *r) for r in rows], budget=300, history=60)
    assert [([(t.role, t.text) for t in w.turns], w.n_repeated) for w in got] == slow_windows(rows, 300, 60)
    assert [x for w in got for x in w.masked] == [t for _, r, t in sorted((-1 if n is None else n, r, t) for n, r, t in rows) if r == "assistant"]
    filled = [w.n_tokens for w in got]
    assert kind == "endless" or max(filled) <= 300 and sum(filled) / len(filled) > 200
    assert all(w.n_tokens <= 300 or w.n_new == 1 for w in got)


def test_a_long_system_turn_is_not_repeated(spark):
    rows = [(1, 0, "system", "rule " * 5000)] + [(1, i, "user" if i % 2 else "assistant", f"short turn {i}") for i in range(1, 201)]
    got = read(spark, rows)
    assert sum(len(w.formatted) for w in got) < 1.5 * sum(len(r[3]) for r in rows) + 40 * len(rows)
    assert [w.n_tokens > chat.BUDGET for w in got] == [True] + [False] * (len(got) - 1) and got[0].n_new == 1
    fits = read(spark, [(1, 0, "system", "rule " * 500)] + rows[1:])
    assert len(fits) > 1 and all(w.turns[0].role == "system" and w.n_tokens <= chat.BUDGET for w in fits)


def test_one_conversation_over_many_partitions(spark):
    rows = [(1, i, "user", f"turn {i}") for i in range(3000)] + [(2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(9)
    got = chat.windows(df).orderBy("conv", "section", "span").collect()
    assert len(got) > 10 and sum(w.n_new for w in got) == 3001
    assert all(a.section * chat.SECTION_WINDOWS <= b.section * chat.SECTION_WINDOWS for a, b in zip(got, got[1:]) if a.conv == b.conv)


def test_token_estimate(spark):
    texts = {"": 0, "four five words": 1 + 1 + 2, "a, b.": 4, "東京は日本": 5, "ไทย": 3, "Straße": 2, "日本 test": 3, "\t \n": 0}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.estimated_tokens(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == texts


def test_edges_chat(spark):
    assert read(spark, []) == []
    got = read(spark, [(None, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 3, "assistant", "x" * 100_000)])
    assert sorted(len(w.turns) for w in got) == [1, 1, 2]


def judged(spark, values, rules=URL_RULES):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in values], "page_id long, url string, host string, verdict string")
    return {(r.page_id, i): r for i, r in enumerate(urls.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect())}


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    tail = rest[len(host) :]
    path = tail.split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("bounds", [{}, {"LOOKUP_SHAPES": 0}, {"BROADCAST_RULES": 0}])
def test_urls_against_brute_force(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(urls, name, value)
    values = [
        "http://A.Example.COM/en/700?x#y", "https://example.com/en/8", "https://notexample.com/en/7", "http://x.net/de/", "http://example.net/de/81", "http://sub.example.net/de/9",
        "ftp://org/es/", "org/es/", "http://org", "http://org?/es/", "http://É.org/es/1", None, "", "://", "x://com/en/://org/es/", "http://com/en", "http://a.b.c.d.com/en/zz", "http://com/en/\n1", "http://.com/en/",
    ]
    got = judged(spark, list(enumerate(values)) + [(0, values[0])])
    assert len(got) == len(values) + 1
    for (i, _), r in got.items():
        assert (r.host, r.path, r.rule, r.verdict) == brute(values[i], URL_RULES), values[i]


def test_urls_edges(spark):
    assert judged(spark, []) == {}
    assert [r.verdict for r in judged(spark, [(None, "http://com/en/"), (None, None)]).values()].count("block") == 1
    assert all(r.verdict == "allow" for r in judged(spark, [(1, "http://com/en/")], [(None, None, "block"), ("com", "/en/", None)]).values())
    tie = judged(spark, [(1, "http://com/en/")], [("com", "/en/", "allow"), ("com", "/en/", "block")])
    assert [r.verdict for r in tie.values()] == ["block"]


def test_op1_digests(spark, tmp_path):
    from cellmill.llm.queries import op1_chat

    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "[INST] yo"), (2, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op1_chat(spark, str(tmp_path)).collect()}
    assert set(got) == {-1, 1, 2}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhi </s>\nassistant\n[INST] yo\n").hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (9, hashlib.sha256(b"[INST] yo").hexdigest())
    assert (got[2].n_turns, got[2].loss_chars) == (1, 0)
    assert got[-1].loss_chars == 21


@pytest.mark.parametrize("query", ["op1_chat", "op4_urls"])
def test_native_plan(spark, query):
    from cellmill.llm.queries import QUERIES

    plan = QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
