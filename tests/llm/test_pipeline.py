"""The pipeline against plain Python, stage by stage, each on what its predecessor kept."""

import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .test_operators import LOREM, WORDS, made, reference_fingerprint  # noqa: E402


def test_stages(spark, tmp_path):
    rows = [(k, made(1000 + k, 80 + k % 50), "en", f"s{k % 2}") for k in range(100)]
    rows += [(200, rows[3][1], "en", "s1"), (201, rows[3][1], "en", "s0"), (202, made(7, 60) + " " + LOREM, "en", "s0"), (203, "too short", "en", "s0"), (204, None, None, None), (205, "x " * 80, "en", "s1")]
    d = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, LOREM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, sets = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"o{k}"))
        docs = spark.read.parquet(str(tmp_path / f"o{k}"))
        assert set(docs.columns) == set(d.columns) | ({"slot", "shard"} if k == 4 else set())
        sets.append(Counter(r["doc_id"] for r in docs.select("doc_id").collect()))
    text = {r[0]: r[1] for r in rows}
    assert set(sets[0]) == set(text) - {203, 204, 205}
    fp, groups = {i: reference_fingerprint(text[i]) for i in sets[0]}, {}
    for i in sorted(fp):
        near = {groups[j] for j in groups if bin(fp[i] ^ fp[j]).count("1") <= 2}
        groups[i] = min(near, default=i)
        groups = {j: min(near) if g in near else g for j, g in groups.items()}
    assert set(sets[1]) == set(groups.values()) and 200 not in sets[1] and 201 not in sets[1]
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    item = split(LOREM)
    wins = {tuple(item[k:k + 10]) for k in range(len(item) - 9)}
    dirty = {i for i in sets[1] if any(tuple(split(text[i])[k:k + 10]) in wins for k in range(len(split(text[i]))))}
    assert 202 in dirty and set(sets[2]) == set(sets[1]) - dirty
    assert set(sets[3]) <= set(sets[2]) and max(sets[3].values()) <= 2
    words = sum(len(WORDS(text[i])) * n for i, n in sets[3].items()) / sum(len(WORDS(text[i])) for i in sets[2])
    assert abs(words - 1.5) < 0.05 and sets[4] == sets[3]
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()) == sets[4]


def test_rows_by_themselves(spark, tmp_path):
    """Rows with a null or repeated doc_id are rejected one by one; of a component exactly one row stays."""
    good = [made(1000 + k, 90) for k in range(4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    kept = lambda df: Counter(tuple(r) for r in df.select("doc_id", "text").collect())
    spark.createDataFrame([(1, LOREM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, good[0]), (None, "too short"), (7, good[1]), (7, "too short")]
    assert kept(corpus_pipeline.quality_stage(spark, frame(rows), str(tmp_path))) == Counter([rows[0], rows[2]])
    rows = [(None, good[0]), (None, good[0]), (None, good[1]), (5, good[1]), (6, good[2]), (6, good[2]), (6, good[3])]
    assert kept(corpus_pipeline.near_dedup_stage(spark, frame(rows), str(tmp_path))) == Counter([rows[0], rows[3], rows[4], rows[6]])
    rows = [(None, good[0]), (None, LOREM), (7, good[1]), (7, LOREM)]
    assert kept(corpus_pipeline.decontaminate_stage(spark, frame(rows), str(tmp_path))) == Counter([rows[0], rows[2]])


def test_clashing_columns_and_empty_tables(spark, tmp_path):
    """Columns named like helpers come through each stage with their rows; nulls and empty tables do no harm."""
    spark.createDataFrame([(1, LOREM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row long, _ROW_ string, rank int, _kept int, key string, slot int, shard string, col int, size long"
    rows = [(k if k % 5 else None, made(2000 + k, 80 + k), "en" if k % 2 else None, f"s{k % 2}" if k % 3 else None, k, k, "x", k, 1, "k", k, "s", 3, 4) for k in range(30)]
    docs = spark.createDataFrame(rows, schema)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        cut = tmp_path / f"o{k}"
        stage(spark, docs, str(tmp_path)).write.parquet(str(cut))
        out = spark.read.parquet(str(cut))
        if name == "shard":
            assert set(out.columns) == set(docs.columns) | {"input_slot", "input_shard"}
            assert all(r["input_slot"] == r["n_chars"] and r["input_shard"] == "s" for r in out.collect())
        else:
            assert out.columns == docs.columns and all(r["slot"] == r["n_chars"] == r["_row"] for r in out.collect())
        if name in ("near_dedup", "decontaminate", "shard"):
            assert out.count() == docs.count()
        docs = out if name != "shard" else docs
    none = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_rounds_spare_the_driver(spark, monkeypatch):
    """Stages and file scans take 4 MB of the driver's heap each: rounds over few groups or links make few of them, and over many give the same rows."""
    from textloom.llm import common, mixing, quality, simhash

    docs = [(k, made(3000 + k, 70 + k % 40), f"l{k % 2}", f"s{k % 3}") for k in range(240)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(4).cache()
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90 + k) for k in range(9)], "a long, b long").cache()
    begun = lambda: int(str(spark.sparkContext._jsc.sc().dagScheduler().nextStageId()))

    def run():
        found, used = [], []
        for made_ in (lambda: quality.quality_rules(docs), lambda: mixing.mix(docs), lambda: simhash.components(edges)):
            at = begun()
            found.append(sorted(map(tuple, made_().collect())))
            used.append(begun() - at)
        return found, used

    few, used = run()
    assert few[2] == [(k, 0) for k in range(1, 41)] + [(k, 90) for k in (*range(91, 99), 100)]
    assert used[1] <= 58 and used[2] <= 160  # before: 72 and 193
    monkeypatch.setattr(common, "HELD_ROWS", 0)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    assert run()[0] == few
