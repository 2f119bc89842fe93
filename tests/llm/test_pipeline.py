"""The pipeline's stages, each on its own input."""

import hashlib
import os
import random

import numpy as np
import tiktoken

import corpus_pipeline as pipeline
from chronofold.llm import bpe
from chronofold.llm.common import shared_dir
from chronofold.llm.queries import PATTERN, RANKS
from tests.llm.test_corpus import brute_components


def test_stages_in_turn(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    junk = {-10 - k: t for k, t in enumerate([draw(400), draw(2000), "Все люди рождаются свободными и равными в своем достоинстве", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", None, "", "12 34 ### 😀"])}
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, "src1", len(t or "")) for i, t in junk.items()], docs.schema))
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    kept = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "encoding" or docs.columns == columns
    assert not set(junk) & set(kept["language ID"])
    assert len(kept["language ID"]) >= 0.99 * (len(before) - len(junk))
    assert all(kept["language ID"][i].text == before[i].text for i in kept["language ID"])
    assert all(r.text and r.n_chars == len(r.text) for r in kept["line dedup"].values())
    want = brute_components([(i, r.text) for i, r in kept["line dedup"].items()], pipeline.NEAR)
    assert set(kept["near-duplicates"]) == {i for i, (_, _, keep) in want.items() if keep}
    words = lambda rows: sum(len(r.text.split(" ")) for r in rows)
    assert words(kept["mixing"].values()) <= 0.75 * words(kept["near-duplicates"].values()) and len(kept["mixing"]) > 0
    theirs = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    for i, r in kept["encoding"].items():
        ids = theirs.encode_ordinary(kept["mixing"][i].text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_run_on_an_empty_table_deletes_its_stages(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    before = _stage_tables(spark)
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    assert {t[:6] for t in _stage_tables(spark) - before} == {"stage5"}


def _stage_tables(spark):
    return {f for f in os.listdir(shared_dir(spark).removeprefix("file://")) if f.startswith("stage")} if os.path.isdir(shared_dir(spark).removeprefix("file://")) else set()
