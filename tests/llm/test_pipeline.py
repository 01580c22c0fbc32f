"""Each pipeline stage against what its operator decides, on the smallest tables."""

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import neardup, pii, quality
from tessera.llm.queries import quality_model
from tessera.llm.text import ship

from test_operators import removed_words, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        rows = out.collect()
        assert 0 < len(rows) <= before
        before = len(rows)
        docs = spark.createDataFrame(rows, docs.schema)
        if name == "near duplicates":
            assert all(r["kept"] for r in neardup.near_duplicates(docs).collect())
        if name == "personal data":
            assert pii.find(docs).where("size(base) > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in rows}


def test_odd_rows(spark):
    odd = spark.createDataFrame([(1, None), (1, None), (None, "x"), (2, ""), (3, "a b c")], "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() >= 0
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_clashing_columns_and_ids(spark):
    rng = np.random.default_rng(8)
    plain = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**9, n))
    a, b, passage = plain(80), plain(80), plain(60)
    table = [(1, a, 7, "x", "k", "s", 9), (1, b, 7, "x", "k", "s", 9), (2, b + " end", 8, "y", "k", "s", 9), (2, b + " end", 8, "y", "k", "s", 9),
             (3, plain(30) + " " + passage, 8, "z", "k", "s", 9), (4, plain(30) + " " + passage + " write to a.b@c.de", 8, "z", "k", "s", 9)]
    odd = spark.createDataFrame(table, "doc_id long, text string, _key long, kept_text string, key string, spans string, number int")
    near = corpus_pipeline.drop_near_duplicates(spark, odd, SF)
    assert near.columns == odd.columns
    assert sorted((r["doc_id"], r["text"]) for r in near.collect()) == sorted([(1, a), (1, b), *((r[0], r[1]) for r in table[4:])])
    assert all((r["_key"], r["kept_text"], r["key"], r["spans"], r["number"]) in {x[2:] for x in table} for r in near.collect())
    cut = corpus_pipeline.drop_repeated_passages(spark, near, SF)
    masked = corpus_pipeline.mask_personal_data(spark, cut, SF)
    got = {r["doc_id"]: r for r in masked.where("doc_id > 2").collect()}
    assert masked.columns == odd.columns and got[3]["text"] == " ".join(table[4][1].split()[:30])
    assert got[4]["text"].endswith("write to [EMAIL]") and passage not in got[4]["text"]
    assert {(r["_key"], r["kept_text"], r["key"], r["spans"], r["number"]) for r in masked.collect()} == {x[2:] for x in table if x[0] != 2}


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_stages_against_brute_force(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    given = docs.toPandas()
    model = quality_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = {r["doc_id"]: r["score"] for r in quality.score(docs, model, 0.7).collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, docs, SF).toPandas()
        out[name] = now
        if name != "packing":
            docs = spark.createDataFrame(now[columns].astype(object).where(pd.notna(now), None).values.tolist(), docs.schema)
    assert sorted(out["quality"].doc_id) == sorted(d for d in given.doc_id if score[d] >= 0.7)
    # near duplicates: components over all pairs, by plain sets
    sets = {d: shingles(t or "") for d, t in zip(out["quality"].doc_id, out["quality"].text)}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, d in enumerate(ids):
        for e in ids[i + 1:]:
            common = len(sets[d] & sets[e])
            if common and 100 * common >= 75 * (len(sets[d]) + len(sets[e]) - common):
                root[max(find(d), find(e))] = min(find(d), find(e))
    assert sorted(out["near duplicates"].doc_id) == [d for d in ids if find(d) == d]
    # repeated passages: kept words by comparing all windows
    before = out["near duplicates"].sort_values("doc_id")
    after = out["repeated passages"].sort_values("doc_id")
    assert list(before.doc_id) == list(after.doc_id)
    for (n, gone, _), was, text in zip(removed_words(list(before.text)), before.text, after.text, strict=True):
        assert len(words(text)) == n - gone and (gone or text == was)
    # personal data: the texts with the operator's spans replaced, one by one
    spans = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(
        after[["doc_id", "text"]].values.tolist(), "doc_id long, text string")).collect()}
    masked = dict(zip(out["personal data"].doc_id, out["personal data"].text))
    for d, text in zip(after.doc_id, after.text):
        want, at = "", 0
        for s in sorted(spans[d], key=lambda s: (s["s"], s["e"], s["kind"])):
            if s["s"] >= at:
                want += text[at:s["s"]] + f"[{pii.KINDS[s['kind']].upper()}]"
            at = max(at, s["e"])
        assert masked[d] == want + text[at:]
    # packing: every id of every document once, in sequences without gaps
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = out["packing"].sort_values(["doc_id", "piece"])
    for d, own in packed.groupby("doc_id"):
        tokens = np.array([*library.encode(masked[d], add_special_tokens=False).ids, 0], "<u4")
        assert own.length.sum() == len(tokens)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(tokens[r.start:r.start + r.length].tobytes())
    assert set(packed.doc_id) == set(masked)
    for _, own in packed.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 2048
