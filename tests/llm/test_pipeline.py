"""The pipeline's stages, each on what the one before it kept."""

import duckdb
import pyarrow.parquet as pq

import __spark_entry__
import corpus_pipeline
from plumbline.llm import decontamination, lines, oracles, simhash, toxicity


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, held, sf).cache()
        assert new.columns == docs.columns
        counts.append(new.count())
        if name == "line dedup":
            assert counts[-1] == counts[-2]
            removed = lines.line_digest(held).agg({"n_removed": "sum"}).first()[0]
            before, after = (df.selectExpr("sum(size(split(text, '\n')))").first()[0] for df in (held.filter("text <> ''"), new.filter("text <> ''")))
            assert removed > 0 and before - after == removed
        if name == "near duplicates":
            groups = simhash.near_copies(held).select("component_id").distinct().count()
            assert counts[-1] == groups
        if name == "decontamination":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert not decontamination.contamination(new, bench).filter("contaminated").count()
            gone = decontamination.contamination(held, bench).filter("contaminated").count()
            assert counts[-1] == counts[-2] - gone
        held = new
    assert counts == sorted(counts, reverse=True)
    assert corpus_pipeline.run(spark, sf).count() == counts[-1]


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def by_sql(docs, sf, sql):
    """Rows of the SQL over ``docs`` as the documents."""
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", pq.read_table(f"{sf}/benchmark.parquet"))
    return con.execute(sql).df().to_dict("records")


def shingles(text):
    words = "".join(c.lower() if c < "\x80" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_every_stage_gives_what_brute_force_gives(spark, sf):
    """Each stage on what the one before it kept: by SQL, by all pairs, and by the classifier's own answers."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())

    calm = stages["toxicity"](spark, docs, sf).cache()
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, labels).filter("predicted = 1").collect()}
    assert toxic and ids(calm) == [i for i in ids(docs) if i not in toxic]

    deduped = stages["line dedup"](spark, calm, sf).cache()
    want = {r["doc_id"]: r["text_md5"] for r in by_sql(calm, sf, oracles.LINES)}
    assert {r["doc_id"]: r["d"] for r in deduped.selectExpr("doc_id", "md5(cast(coalesce(text, '') as binary)) d").collect()} == want

    single = stages["near duplicates"](spark, deduped, sf).cache()
    texts = {r["doc_id"]: r["text"] for r in deduped.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = ids(single)
    # Pairs of 0.8 and more are all found; fingerprints link a few more, so what stays is one of every group or fewer.
    groups = {}
    for i in sets:
        groups.setdefault(find(i), []).append(i)
    assert set(kept) <= set(groups)
    component = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(deduped).collect()}
    assert all(component[i] == component[find(i)] for i in sets) and kept == sorted(set(component.values()))
    assert len(groups) - len(kept) <= 0.05 * len(groups)

    clean = stages["decontamination"](spark, single, sf).cache()
    assert ids(clean) == sorted(r["doc_id"] for r in by_sql(single, sf, oracles.DECONTAMINATION) if not r["contaminated"])

    mixed = stages["mixing"](spark, clean, sf)
    want = sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in by_sql(clean, sf, oracles.MIXING))
    assert sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixed.collect()) == want


def test_documents_without_an_id_in_near_duplicates(spark):
    """They are documents like any other, but one with an id stands for a group before them."""
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"x{i}" for i in range(40))
    rows = [(1, text), (None, text), (None, text + " x"), (None, other), (None, other), (None, "alone"), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted([(1, text), (0, other), (0, "alone"), (7, "")])
