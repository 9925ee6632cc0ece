"""Registered queries of the text operators and their SQL; each reads its whole table."""

from __future__ import annotations

from functools import partial

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, bpe, exact_dedup, jaccard, language, manifest, mixing, packing, pseudonyms, quality, scoring, substrings, toxicity
from tidemark.llm.common import fold_of


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document."""
    found = jaccard.near_duplicates(_documents(spark, folder))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the rows outside fold 2 of 4."""
    docs = _documents(spark, folder)
    fold = fold_of(F.col("doc_id"), 4)
    dictionaries = language.learn(docs, fold != 2)
    found = language.identify(docs, dictionaries)
    return found.select(F.col("id").alias("doc_id"), (fold_of(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score", "accepted", "margin")


#: A fixed key makes the query's results comparable; a user passes a secret one.
PSEUDONYM_KEY = b"fixed key of the registered query"


def op3_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms."""
    made = pseudonyms.pseudonymise(_documents(spark, folder), PSEUDONYM_KEY)
    return made.select(F.col("id").alias("doc_id"), "text", "n_values", "spans")


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again with the public 50k vocabulary."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode_decode(_documents(spark, folder), ranks, public_tokenizers.PATTERN)
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", "n_chars", "ids_sha256", "decoded_sha256")


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    judged = quality.judge(_documents(spark, folder))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(F.col("id").alias("doc_id"), *counts, "base_failed", "kept", "distance")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows outside fold 1 of 3."""
    docs = _documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(fold_of(F.col("doc_id"), 3) != 1)
    scored = toxicity.judge(docs, *toxicity.learn(docs, labels))
    return scored.select(
        F.col("id").alias("doc_id"), (fold_of(F.col("id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_clauses"
    )


def op7_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that repeat a passage of an earlier one, and what is kept."""
    found = substrings.remove_repeats(_documents(spark, folder))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Group, winner and size of every document's exact-copy group."""
    groups = exact_dedup.exact_groups(_documents(spark, folder))
    return groups.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that the mix takes, against its source's target."""
    mixed = mixing.taken(_documents(spark, folder))
    return mixed.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def op10_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document, learned from the rows outside fold 0 of 10."""
    docs = _documents(spark, folder)
    fold = fold_of(F.col("doc_id"), 10)
    scored = scoring.score(docs, F.when(fold == 0, 0).when(fold == 1, 2).otherwise(1))
    return scored.select(F.col("id").alias("doc_id"), (fold_of(F.col("id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Merkle proof of every document, and whether its leaf, tampered with in every seventh, still leads to the root."""
    docs = _documents(spark, folder)
    fields = {name: F.col(name) for name in manifest.FIELDS}
    tampered = manifest.leaf(list({**fields, "n_chars": F.col("n_chars") + 1}.values()))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = manifest.manifest(docs, carried={"tampered": F.when(hit, tampered)})
    root = manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    shown = made.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"), root.alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's groups and links between byte-level tokens and pieces, and how common its links are."""
    open_a = partial(alignment.byte_level, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    open_b = partial(alignment.pieces, public_tokenizers.path("piece_bpe_32k.model"))
    found = alignment.align(_documents(spark, folder), open_a, open_b)
    return found.select(
        F.col("id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256")
    )


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens, neighbours on a Hilbert curve together."""
    packed = packing.pack(_documents(spark, folder), partial(packing.word_coder, public_tokenizers.path("word_bpe_49k.json")))
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_jaccard": op1_jaccard,
    "op10_scoring": op10_scoring,
    "op11_manifest": op11_manifest,
    "op12_alignment": op12_alignment,
    "op13_packing": op13_packing,
    "op2_language": op2_language,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_byte_bpe": op4_byte_bpe,
    "op9_mixing": op9_mixing,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_substrings": op7_substrings,
    "op8_exact_dedup": op8_exact_dedup,
}

ORACLE = {
    "op1_jaccard": r"""
with recursive texts as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g
  from texts),
sizes as (select doc_id, count(*) as n from shingles group by 1),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select s.a, s.b from shared s join sizes x on x.doc_id = s.a join sizes y on y.doc_id = s.b where 100 * s.n >= 75 * (x.n + y.n - s.n)),
edges as (select a, b from links union all select b, a from links),
reach as (
  select doc_id, doc_id as other from documents
  union
  select r.doc_id, e.b from reach r join edges e on e.a = r.other)
select d.doc_id, coalesce(any_value(s.n), 0) as n_shingles, min(d.other) as component_id
from reach d left join sizes s on s.doc_id = d.doc_id group by d.doc_id
""",
    "op11_manifest": r"""
with recursive fields as (
  select doc_id, lang, n_chars, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
         coalesce(strlen(text) || ':' || text, '-') as tail,
         xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint),
             lambda h, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda v, i: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, xor(h, b)),
             4294967295::bigint), 4294967295::bigint) % 7 = 0 as hit
  from documents),
leaves as (
  select doc_id, lang, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
         sha256(head || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || tail) as altered, hit
  from fields),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from leaves),
nodes as (
  select lang, 0 as level, i, n, leaf as h from placed
  union all
  select lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from nodes where n > 1 group by lang, level, i // 2, n),
subroots as (select lang, level as height, h as subroot, row_number() over (order by lang nulls first) - 1 as t, count(*) over () as n from nodes where n = 1),
top as (
  select 0 as level, t as i, n, subroot as h from subroots
  union all
  select level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from top where n > 1 group by level, i // 2, n),
crown as (select level as height, h as root from top where n = 1),
steps as (
  select p.doc_id, p.leaf, p.i, s.lang, l.level as step, (p.i >> l.level) % 2 as own, x.h
  from placed p join subroots s on s.lang is not distinct from p.lang
  cross join (select unnest(range(0, 64)) as level) l
  left join nodes x on x.lang is not distinct from p.lang and x.level = l.level and x.i = xor(p.i >> l.level, 1) and x.n > 1
  where l.level < s.height
  union all
  select p.doc_id, p.leaf, p.i, s.lang, s.height + l.level, (s.t >> l.level) % 2, x.h
  from placed p join subroots s on s.lang is not distinct from p.lang
  cross join (select unnest(range(0, 64)) as level) l cross join crown c
  left join top x on x.level = l.level and x.i = xor(s.t >> l.level, 1) and x.n > 1
  where l.level < c.height),
paths as (select lang, i, list(struct_pack(own := own, h := coalesce(h, '')) order by step) as path, string_agg(coalesce(h, ''), '' order by step) as joined from steps group by lang, i),
folds as (
  select lang, i, case when hit then altered else leaf end as h, 1 as step from placed
  union all
  select f.lang, f.i, sha256(case when p.path[f.step].own = 1 then p.path[f.step].h || f.h else f.h || p.path[f.step].h end), f.step + 1
  from folds f join paths p on p.lang is not distinct from f.lang and p.i = f.i where f.step <= len(p.path)),
ends as (select lang, i, arg_max(h, step) as folded from folds group by lang, i)
select p.doc_id, p.leaf, s.subroot, c.root, sha256(coalesce(q.joined, '')) as proof_sha256, e.folded as folded_root, e.folded = c.root as verified
from placed p join subroots s on s.lang is not distinct from p.lang cross join crown c
join ends e on e.lang is not distinct from p.lang and e.i = p.i
left join paths q on q.lang is not distinct from p.lang and q.i = p.i
""",
    "op7_substrings": r"""
with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from texts)),
origin as (select g, min(doc_id) as m from windows group by 1),
gone as (select distinct doc_id, i + k as p from (
  select x.doc_id, x.i, unnest(range(0, 13)) as k from windows x join origin o on o.g = x.g where o.m < x.doc_id)),
words as (select doc_id, p, w[p] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from texts)),
kept as (select x.doc_id, string_agg(x.word, ' ' order by x.p) as kept from words x left join gone g on g.doc_id = x.doc_id and g.p = x.p where g.p is null group by 1),
removed as (select doc_id, count(*) as n from gone group by 1)
select t.doc_id, len(t.w) as n_words, coalesce(r.n, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from texts t left join removed r on r.doc_id = t.doc_id left join kept k on k.doc_id = t.doc_id
""",
    "op8_exact_dedup": r"""
with base as (
  select doc_id, length(coalesce(text, '')) as n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents),
ranked as (
  select doc_id, text_sha256,
         first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id
           rows between unbounded preceding and unbounded following) as keep_id,
         count(*) over (partition by text_sha256) as group_size
  from base)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from ranked
""",
}
