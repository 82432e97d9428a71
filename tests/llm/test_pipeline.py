import re

import corpus_pipeline as pipeline
from tallyloom.llm import decontaminate, langid, linededup, simhash

from .test_operators import ITEMS, brute_components, brute_hits, brute_lines, brute_print, sha


def test_stages_against_brute_force(spark, docs, table, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    own.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [r[:5] for r in table]
    # 1: texts without letters go; no class of lengths has texts enough here to judge by
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    found = pipeline.language(spark, own, str(tmp_path))
    assert found.schema == own.schema and sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in found.collect())
    # 2
    found = pipeline.lines(spark, found, str(tmp_path))
    assert found.schema.names == own.schema.names
    assert sorted((str(r.doc_id), sha(r.text)) for r in found.collect()) == sorted((str(x[0]), x[3]) for x in brute_lines(rows))
    rows = [tuple(r) for r in found.collect()]
    # 3
    comp = brute_components([(r[0], brute_print(r[1])) for r in rows])
    found = pipeline.near_duplicates(spark, found, str(tmp_path))
    rows = [r for r, c in zip(rows, comp) if r[0] is None or r[0] == c]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in found.collect())
    # 4
    rows = [r for r, x in zip(rows, brute_hits(rows, ITEMS)) if not x[5]]
    found = pipeline.decontamination(spark, found, str(tmp_path))
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in found.collect())
    # 5
    found = pipeline.mix(spark, found, str(tmp_path)).collect()
    assert {r.doc_id for r in found} <= {r[0] for r in rows} and all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) and 0 < r.taken <= 2 * r["size"] for r in found)
    whole = pipeline.run(spark, str(tmp_path))
    assert sorted(repr(tuple(r)) for r in whole.collect()) == sorted(repr(tuple(r)) for r in found)


def test_stages_take_empty_tables(spark, docs, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    none = docs.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    assert [m.__name__ for m in (langid, linededup, simhash, decontaminate)] and pipeline.ORACLE_SQL is None


def test_finished_stages_are_removed(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    kept = lambda whole: sorted({os.path.basename(os.path.dirname(f.removeprefix("file://"))) for f in whole.inputFiles()})
    place = lambda whole: os.path.dirname(os.path.dirname(whole.inputFiles()[0].removeprefix("file://")))
    short = pipeline.run(spark, sf)
    assert kept(short) == ["4-mix"] and os.listdir(place(short)) == ["4-mix"] and short.count() > 0
    full = pipeline.run(spark, sf, keep_stages=True)
    assert sorted(os.listdir(place(full))) == [f"{i}-{n}" for i, (n, _) in enumerate(pipeline.STAGES)] and full.count() == short.count()
