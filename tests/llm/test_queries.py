"""Registered queries: names, columns, SQL, and the pipeline against plain Python."""

import os
import re
import sys

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from check_oracle import TABLES, canonical  # noqa: E402

from tidemark.llm import bpe, mixing, quality, queries  # noqa: E402

COLUMNS = {
    "op1": {"doc_id", "n_shingles", "component_id"},
    "op2": {"doc_id", "held_out", "lang_pred", "score"},
    "op3": {"doc_id", "text"},
    "op4": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op5": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op6": {"doc_id", "held_out", "score", "predicted"},
    "op7": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op8": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op9": {"doc_id", "size", "source_size", "target", "taken"},
    "op11": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
    "op12": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op13": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op10": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"pipeline"}))
def test_one_row_a_document(spark, folder, name):
    got = entry.queries()[name](spark, folder)
    assert COLUMNS[name.split("_")[0]] <= set(got.columns)
    # packing has a row a piece: one of each document starts it
    got = got.where("start = 0") if name.startswith("op13") else got
    ids = sorted(r["doc_id"] for r in got.select("doc_id").collect())
    assert ids == sorted(r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect())


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {*COLUMNS, "pipeline"}
    assert queries.QUERIES.items() <= entry.queries().items() and set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, folder).toPandas(), con.execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["id"] for r in quality.judge(docs).where("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in kept}
    best = {}
    for doc_id in sorted(texts, key=lambda k: (-len(texts[k]), k)):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", texts[doc_id]), doc_id)
    single = sorted(best.values())
    sets = {}
    for k in single:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[k]))
        sets[k] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}
    label = {k: k for k in single}
    for i, a in enumerate(single):
        for b in single[:i]:
            if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    final = {k for k, v in label.items() if k == v}
    mixed = mixing.mixed_documents(docs.where(docs["doc_id"].isin(list(final)))).collect()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((r["doc_id"], len(np.array(library.encode_ordinary(r["text"])))) for r in mixed)
    got = corpus_pipeline.run(spark, folder)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want
    assert [name for name, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
