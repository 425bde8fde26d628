"""The pipeline's decisions against plain versions of its stages, and its edge cases."""

import collections
import itertools

import corpus_pipeline as cp
import numpy as np

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def text(n, seed):
    return " ".join(f"w{i}" for i in np.random.default_rng(seed).integers(0, 4000, n))


def test_stages(spark, tmp_path):
    shared = text(60, 900)
    rows = [(i, ("|| " * 9 if i % 5 == 0 else "") + text(90, i), "en", "s", 1, "keep") for i in range(60)]
    rows += [(100, text(90, 1), "en", "s", 1, None), (101, text(90, 1) + " end", None, None, None, "keep"), (102, f"{text(30, 501)} {shared} {text(30, 502)}", "en", "s", 1, "k"), (103, f"{text(30, 503)}\n{shared}\n{text(30, 504)}", "en", "s", 1, "k")]
    rows += [(104, f"{text(40, 505)} {text(20, 700)} {text(9, 506)}", "en", "s", 1, "k"), (105, None, None, None, None, None), (106, "", "en", "s", 0, "k"), (107, text(80, 508), "en", "s", 1, "k"), (107, text(80, 508), "en", "s", 1, "k"), (None, text(80, 509), "en", "s", 1, "k")]
    d = str(tmp_path)
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, text(20, 700))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(cp.STAGES)
    good = stages["quality_classifier"](spark, docs, d)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {r[0] for r in rows if not (r[1] or "").startswith("||")}
    ids = lambda df: collections.Counter(r.doc_id for r in df.collect())
    near = stages["minhash_near_dedup"](spark, good, d)
    assert near.columns == docs.columns

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {r.doc_id: shingles(r.text) for r in good.collect() if r.doc_id is not None}
    gone = {b for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert gone == {100, 101} and ids(near) == collections.Counter(i for i in {*sets, None} if i not in gone)
    cut = stages["substring_dedup"](spark, near, d)
    assert cut.columns == docs.columns
    by = {r.doc_id: r for r in cut.collect()}
    assert by[102].text.split() == (text(30, 501) + " " + text(30, 502)).split() and by[103].n_chars == len(by[103].text)
    assert by[107].text == text(80, 508) and by[105].text is None and by[107].n_chars == 1
    clean = stages["benchmark_decontamination"](spark, cut, d)
    assert clean.columns == docs.columns and ids(cut) - ids(clean) == {104: 1}
    packed = stages["best_fit_packing"](spark, clean, d)
    assert ids(packed) == ids(clean)
    assert ids(cp.run(spark, d)) == ids(clean)


def test_empty_documents(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert cp.run(spark, d).count() == 0


def test_a_text_that_shares_an_id_with_a_copy_stays(spark):
    a, b = text(60, 1), text(60, 2)
    rows = [(3, a), (7, a), (7, b), (7, b), (9, b + " x"), (8, None), (8, None), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "k") for i, t in rows], COLUMNS)
    kept = cp.near_dedup_stage(spark, docs, "").collect()
    assert collections.Counter((r.doc_id, r.text) for r in kept) == collections.Counter([(3, a), (7, b), (8, None), (None, a)])
