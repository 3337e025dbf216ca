"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from zonewise.llm import decontaminate, importance, language, licenses, mixing, pii, rules, simhash

BY_DOCUMENT = {
    "mix": lambda d, x: mixing.mix(d),
    "rules": lambda d, x: rules.judge(d, x["labels"]),
    "licenses": lambda d, x: licenses.scan(d),
    "language": lambda d, x: language.identify(d),
    "pii": lambda d, x: pii.find(d),
    "importance": lambda d, x: importance.resample(d, x["labels"]),
    "simhash": lambda d, x: simhash.near_duplicates(d),
    "decontaminate": lambda d, x: decontaminate.contamination(d, x["items"]),
}


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_one_row_per_document(name, edge, odd, none, labels, items):
    run, x = BY_DOCUMENT[name], {"labels": labels, "items": items}
    first = sorted(map(str, run(edge, x).collect()))
    assert len(first) == edge.count()
    assert sorted(map(str, run(odd, x).collect())) == first, "further columns don't matter, and reruns agree"
    assert run(none, x).count() == 0


@pytest.mark.parametrize("name", ["rules", "importance"])
def test_without_labels(name, edge, labels, items):
    assert BY_DOCUMENT[name](edge, {"labels": labels.limit(0), "items": items}).count() == edge.count()


def test_without_items(edge, items):
    got = decontaminate.contamination(edge, items.limit(0))
    assert got.where("n_hit > 0 OR contaminated OR n_items > 0").count() == 0 and got.count() == edge.count()


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark, labels, items):
    out = tmp_path_factory.mktemp("sf")
    labels.write.parquet(f"{out}/labels.parquet")
    items.write.parquet(f"{out}/benchmark.parquet")
    return str(out)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages(name, stage, spark, folder, edge, odd, none):
    for docs in (edge, odd, none):
        out = stage(spark, docs, folder)
        assert set(docs.columns) <= set(out.columns)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.count() <= docs.count()
    kept = {r["doc_id"] for r in stage(spark, edge, folder).collect()}
    if name in ("quality", "privacy"):
        assert {1, 8} <= kept


def test_run(spark, folder, edge, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in got]
    assert len(ids) == len(set(ids)) and all(r["copies"] >= 1 for r in got)
    assert not any("bob@x.org" in (r["text"] or "") for r in got)


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Stages after the first, whose model is hashed, against plain Python over the same rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf = "/root/testdata/sf0.001"
    rows = docs.collect()
    # near duplicates: one per component
    prints = {r["doc_id"]: simhash.fingerprint((r["text"] or "").encode()) for r in rows}
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1") <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, docs, sf)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in ids if root(i) == i}
    # benchmark: no contaminated text is left, others are unchanged
    before = {r["doc_id"]: r["contaminated"] for r in decontaminate.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    clean = stages["benchmark"](spark, docs, sf)
    assert not any(r["contaminated"] for r in decontaminate.contamination(clean, spark.read.parquet(f"{sf}/benchmark.parquet")).collect())
    texts = {r["doc_id"]: r["text"] for r in rows}
    for r in clean.collect():
        assert (r["text"] == texts[r["doc_id"]]) == (not before[r["doc_id"]])
    # privacy: nothing that the patterns find is left
    for r in stages["privacy"](spark, docs, sf).collect():
        assert pii.base_spans(r["text"]) == []
    # mix: copies as the digest says
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).where("copies > 0").collect()}
    assert {r["doc_id"]: r["copies"] for r in stages["mix"](spark, docs, sf).select("doc_id", F.col("copies")).collect()} == want

CLASHES = ("key", "id", "body", "calls", "anchor", "depth", "c1", "i1", "note", "found", "row", "hits", "text", "n_chars", "host", "n", "keys")


def with_clashes(df):
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(CLASHES) if n not in df.columns])


def test_chat_edges(spark):
    from zonewise.llm import chat

    call = '{"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "x"}}]}'
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, ""), (None, None, None, None), (2, 0, "assistant", call), (2, 0, "assistant", call), (2, 1, "tool", '{"tool_call_id": "a", "content": null}'), (3, 0, "user", "long text " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    first = sorted(map(str, chat.format_chat(df).collect()))
    assert len(first) == len(rows)
    assert sorted(map(str, chat.format_chat(with_clashes(df)).collect())) == first
    assert chat.format_chat(df.limit(0)).count() == 0


def test_page_edges(spark):
    from zonewise.llm import html

    rows = [(1, "http://a.org", "<article><p>x</p></article>"), (1, "http://a.org", "<article><p>x</p></article>"), (2, None, None), (None, "", ""), (3, "http://a.org", "<div>" * 20_000 + "deep"), (4, "http://a.org", "<article>" + "<p>word " * 100_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (html.MAX_BROADCAST, -1):
        got = html.main_text(df, max_broadcast=limit).collect()
        assert len(got) == len(rows)
        assert sorted(map(str, html.main_text(with_clashes(df), max_broadcast=limit).collect())) == sorted(map(str, got))
        by = {r["page_id"]: r for r in got}
        assert by[3]["text"] == "deep" and by[4]["text"].count("\n") == 99_999 and by[2]["n_chars"] == 0
        assert html.main_text(df.limit(0), max_broadcast=limit).count() == 0
