"""The pipeline's stages against their operators' own decisions, and what passes through."""

from collections import Counter

import corpus_pipeline
from loglattice.llm import langid, toxicity
from tests.llm.test_dedup import near_ids


def test_stages(spark, sf_dir, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "exact_dedup", "simhash_near_dedup", "best_fit_packing"]
    now, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir).persist()
        assert now.schema.names == docs.schema.names and now.dtypes == docs.dtypes
        kept.append({r.doc_id: r.text for r in now.collect()})
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    flagged = {r.doc_id for r in toxicity.predict(docs, toxicity.fit(docs, labels)).where("toxic").collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept[0]) == set(rows) - flagged and flagged
    civil = spark.createDataFrame([(i, rows[i]) for i in sorted(kept[0])], "doc_id long, text string").join(docs.select("doc_id", "lang"), "doc_id")
    own = langid.Labeller(langid.fit(civil))
    unknown = {i for i, text in ((i, rows[i]) for i in kept[0]) for k, _, sure in own.label([text]) if k == "und" or sure < langid.ACCEPT}
    assert set(kept[1]) == set(kept[0]) - unknown
    largest = {}
    for i, t in kept[1].items():
        largest[t] = max(i, largest.get(t, i))
    assert set(kept[2]) == set(largest.values())
    assert set(kept[3]) == near_ids([(i, t, None) for i, t in kept[2].items()])
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).toPandas()
    assert set(packed.doc_id) == set(kept[3]) and packed.groupby("sequence_id").length.sum().max() <= 2048
    whole = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert Counter(zip(whole.doc_id, whole.piece, whole.ids_crc32, strict=True)) == Counter(zip(packed.doc_id, packed.piece, packed.ids_crc32, strict=True))


def test_odd_rows_pass_through_every_stage(spark, tmp_path):
    """Repeated and null doc_ids, null, empty and very long texts, and columns named as those that stages use."""
    from pyspark.sql import functions as F

    prose = "the quick brown fox jumps over the lazy dog while the old man sleeps under a green tree "
    rows = [(9, prose, "en"), (7, prose, "en"), (7, prose + "or not", "en"), (None, prose, "en"), (3, None, None), (4, "", "en"), (5, prose * 3000, "en"), (6, "!!! 123", "en"), (None, prose * 2, "en")]
    docs = spark.createDataFrame([(*r, "s", 1, 77 + k, "d") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, _copy long, digest string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(9, 0, 0), (3, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).persist()
        assert now.dtypes == docs.dtypes
        sizes.append(Counter((r.doc_id, r.text) for r in now.collect()))
        assert all(rows[r._copy - 77][:2] == (r.doc_id, r.text) and r.digest == "d" for r in now.collect())
    # Texts without a letter go with the languages; of the equal texts the row with doc_id 9 stays, and 7 with its own text.
    assert sizes[0] == Counter((i, t) for i, t, _ in rows) and sizes[1] == Counter((i, t) for i, t, _ in rows if t and "fox" in t)
    assert sizes[2] == Counter([(9, prose), (7, prose + "or not"), (5, prose * 3000), (None, prose * 2)])
    assert set(sizes[3]) <= set(sizes[2]) and sum(sizes[3].values()) >= 1
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == len({i for i, _ in sizes[3]})
    spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).write.parquet(str(tmp_path / "none/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0 and packed.where(F.col("length") > 2048).count() == 0
