"""The stages on the smallest tables, each against what its operator promises."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_columns_stay(results):
    for name in ("quality", "line_dedup", "near_dedup", "decontaminate"):
        assert results[name].columns == results["documents"].columns


def test_quality_keeps_good_and_drops_bad(spark, results):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    share = lambda df, q: df.join(labels.filter(F.col("quality") == q), "doc_id").count()
    assert share(results["quality"], 1) >= 0.95 * share(results["documents"], 1)
    assert share(results["quality"], 0) <= 0.3 * share(results["documents"], 0)


def test_no_line_is_left_in_three_documents(results):
    assert results["line_dedup"].count() == results["quality"].count()
    line = F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.lower(F.trim(x)))))
    assert results["line_dedup"].select("doc_id", line.alias("l")).filter(F.length("l") >= 20).groupBy("l").count().filter("count >= 3").isEmpty()


def test_copies_and_leaks_are_gone(spark, results):
    assert results["near_dedup"].groupBy("text").count().filter("count > 1").isEmpty()
    from fleetlens.llm.decontam import find_contamination

    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert find_contamination(results["decontaminate"], benchmark).filter("n_hit > 0").isEmpty()
    clean = find_contamination(results["near_dedup"], benchmark).filter("n_hit = 0").count()
    assert results["decontaminate"].count() == clean


def test_run_gives_the_last_stage(spark, results):
    key = ["doc_id", "size", "copies", "taken"]
    assert sorted(corpus_pipeline.run(spark, SF).select(key).collect()) == sorted(results["mixing"].select(key).collect())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of small tables with nulls, repeats, ties, a long text and columns named like those inside the operators."""
    folder = str(tmp_path_factory.mktemp("odd"))
    names = ("row", "key", "root", "t", "fp", "node", "gone", "n_lines", "copies", "block", "p", "s_key", "kept")
    text = [f"good words number {i} and some more of them here" for i in range(30)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(text)] + [(30, None, None, None), (31, "", "en", "s0"), (32, "  ", "en", "s1"), (None, text[3], "en", "s1"), (None, "an unnamed one", "en", None)]
    rows += [(40, "twin of itself", "en", "s0")] * 3 + [(41, "long " * 60_000, "en", "s2"), (42, "the passage that is in the benchmark and should go away", "en", "s1")]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *names) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(40, 1, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "the passage that is in the benchmark and should go away"), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, names


def test_stages_on_odd_rows(spark, odd):
    folder, names = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert {tuple(r[n] for n in names) for r in found} == {names}, name
        ids = sorted(str(r.doc_id) for r in found)
        if name in ("quality", "line_dedup"):  # only a few labels of one class are known: all stay
            assert len(found) == before
        elif name == "near_dedup":
            assert ids.count("40") == 1 and sum(not (r.text or "").strip() for r in found) == 1 and ids.count("None") == 1
        else:
            assert "42" not in ids and "41" in ids
        if name == "line_dedup":
            assert all(r.text is not None and r.n_chars == len(r.text) for r in found)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    mixed = corpus_pipeline.mixing(spark, docs, folder).collect()
    assert len(mixed) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in mixed)


def test_stages_on_an_empty_table(spark, odd):
    folder, _ = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_near_duplicates_by_brute_force(spark, results):
    """All pairs at 0.8 or above among the documents that line dedup leaves are found: the kept rows are one of each component."""
    rows = results["line_dedup"].select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        w = [x.decode() for x in r.text.lower().encode().split()]
        sets[r.doc_id] = frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert links and {r.doc_id for r in results["near_dedup"].select("doc_id").collect()} == {root(i) for i in ids}
