"""Keys that a third of all rows share, and input columns named like those that operators use inside."""

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import common
from fleetlens.llm.common import ensure_checkpoint_dir, spread_join
from fleetlens.llm.line_dedup import dedup_lines
from fleetlens.llm.simhash import keep_one
from fleetlens.llm.url_filter import host_rule, judge_urls, pattern_rule


@pytest.mark.parametrize("how", ["left", "inner"])
def test_a_hot_key_goes_to_many_tasks(spark, how):
    rows = [("hot", i) for i in range(500)] + [(None, i) for i in range(200)] + [(f"k{i % 40}", i) for i in range(200)]
    left = spark.createDataFrame(rows, "key string, n int").repartition(5, "n").cache()
    table = spark.createDataFrame([("hot", 1), (None, 9), *[(f"k{i}", i) for i in range(0, 60, 2)]], "key string, v int").cache()
    want = {str(k): v for k, v in table.collect() if k is not None}
    got = spread_join(left, table, "key", how, limit=0, hot=20)
    plan = [(str(r.key), r.n, r.v) for r in got.collect()]
    assert len(plan) == sum(how == "left" or k in want for k, _ in rows)
    assert {(k, n): v for k, n, v in plan} == {(str(k), n): (want.get(k) if k is not None else None) for k, n in rows if how == "left" or k in want}
    assert got.columns == ["key", "n", "v"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = spread_join(left, table, "key", how, limit=0, hot=20).withColumn("p", F.spark_partition_id())
        assert spread.filter("key = 'hot'").select("p").distinct().count() > 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_line_dedup_keeps_columns_of_any_name(spark, monkeypatch):
    line = "a line that is long enough to count"
    names = ("l_mine", "l_gone", "l_doc", "l_text", "gone", "row", "key", "numbers", "keeper", "m_doc")
    rows = [(i, f"own {i}\n{line}\n\nlast", *[f"{n}{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, " + ", ".join(f"{n} string" for n in names))
    for limit in (common.BROADCAST, 0):
        monkeypatch.setattr("fleetlens.llm.line_dedup.spread_join", lambda a, b, k, h, limit=limit: spread_join(a, b, k, h, limit=limit, hot=2))
        got = sorted(dedup_lines(docs).collect())
        assert [tuple(r[c] for c in names) for r in got] == [r[2:] for r in rows]
        assert [r.text for r in got] == [f"own {i}\n\nlast" for i in range(5)] + [f"own 5\n{line}\n\nlast"]
        assert [(r.n_lines, r.n_dropped) for r in got] == [(4, 1)] * 5 + [(4, 0)]


def test_line_dedup_of_very_many_lines(spark):
    n = 60_000
    text = "\n".join(f"number {i} of very many lines" for i in range(n))
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id int, text string")
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in dedup_lines(docs).collect()) == [(0, n, n), (1, n, n), (2, n, 0)]


def test_url_filter_keeps_columns_of_any_name(spark):
    names = ("u_tokens", "u_asked", "u_fit", "f_host", "f_path", "row", "tokens", "fit", "token", "first")
    pages = spark.createDataFrame([(1, "http://a.org/ads/x", *names), (2, None, *names)], "page_id int, url string, " + ", ".join(f"{n} string" for n in names))
    for inline in (500, 0):
        got = sorted(judge_urls(pages, (host_rule("allow", "org"),), (pattern_rule("block", "/ads/"),), inline=inline).collect())
        assert [tuple(r[c] for c in names) for r in got] == [names, names]
        assert [(r.host, r.rule, r.verdict) for r in got] == [("a.org", "org/", "allow"), ("", None, "allow")]


def test_urls_fetch_only_rules_of_their_tokens(spark):
    rules = tuple(host_rule("block", f"site{i}.example") for i in range(300)) + (pattern_rule("block", "x*y"),)
    pages = spark.createDataFrame([(i, f"https://www.site{i}.example/p") for i in range(0, 400, 7)], "page_id int, url string")
    got = judge_urls(pages, rules, ())
    assert {r.page_id: r.rule for r in got.collect()} == {i: f"site{i}.example/" if i < 300 else None for i in range(0, 400, 7)}


def test_keep_one_keeps_columns_of_any_name(spark):
    names = ("k_turn", "k_doc", "k_t", "t", "root", "row", "r_doc", "r_t", "fp", "node")
    rows = [(1, "the same words in both of them", *names), (2, "the same words in both of them", *names), (2, "the same words in both of them", *names), (3, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, " + ", ".join(f"{n} string" for n in names))
    got = keep_one(docs).collect()
    assert sorted(r.doc_id for r in got) == [1, 3] and all(tuple(r[c] for c in names) == names for r in got) and docs.columns == got[0].__fields__
    assert keep_one(docs.limit(0)).count() == 0


def test_only_a_local_master_makes_a_checkpoint_folder():
    class Context:
        master = "spark://somewhere:7077"
        asked = []

        class _jsc:
            @staticmethod
            def sc():
                return type("Sc", (), {"getCheckpointDir": lambda self: type("None_", (), {"isEmpty": lambda self: True})()})()

        def getConf(self):
            return {}

        def setCheckpointDir(self, folder):
            self.asked.append(folder)

    session = type("Session", (), {"sparkContext": Context()})()
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(session)
    session.sparkContext.master = "local[2]"
    ensure_checkpoint_dir(session)
    assert len(Context.asked) == 1
