"""Registered queries of the operators of this package, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import (
    bytebpe, crosspolytope, crosstoken, htmltext, jaccard, langid, mixing, negatives, neighbours, packing, quality, substrings, suffixes,
)

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public vocabulary lies on this machine; every executor has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.plan_mix(table(spark, sf_dir, "documents")))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest_neighbours(vectors, F.col("vec_id") % 100 == 0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_language(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_suffixes(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages"))


def op11_align_vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstoken.align_vocabularies(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.token_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_nearest_vectors": op2_nearest_vectors,
    "op3_language_id": op3_language_id,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_near_vectors": op8_near_vectors,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_html_text": op10_html_text,
    "op11_align_vocabularies": op11_align_vocabularies,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_hard_negatives": op13_hard_negatives,
}
#: Vectors that take part, for the SQL below.
_VECTORS = """
    select vec_id, embedding, label from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0"""
_DOT = "list_reduce(list_transform(list_zip({0}.embedding, {1}.embedding), lambda z: z[1]::double * z[2]::double), lambda p, q: p + q)"

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op4_suffix_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
        pieces as (select doc_id, n, j, substr(h, 800 * j + 1, 1600) as piece from (select *, unnest(range(0, n // 400)) as j from d where n >= 400)),
        w as (
            select doc_id, 400 * j + i as i, md5(substr(piece, 2 * i + 1, 800)) as s from (select *, unnest(range(0, 400)) as i from pieces)
            where 400 * j + i + 400 <= n
        ),
        starts as (select doc_id, i from w where s in (select s from w group by s having count(*) > 1)),
        parts as (
            select doc_id, i, sum(fresh) over (partition by doc_id order by i) as part from (
                select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 400 then 0 else 1 end as fresh from starts)
        ),
        spans as (select doc_id, part, min(i) as low, max(i) + 400 as high from parts group by doc_id, part),
        gaps as (select *, coalesce(lag(high) over (partition by doc_id order by low), 0) as before from spans),
        cut as (
            select g.doc_id, sum(high - low) as gone, count(*) as n_spans, max(high) as last,
                string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' order by low) as kept
            from gaps as g join d on d.doc_id = g.doc_id group by g.doc_id
        )
        select d.doc_id, n as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
            sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
        from d left join cut on cut.doc_id = d.doc_id""",
    "op7_jaccard_join": f"""
        with recursive w as (select doc_id, {_WORDS} as w from documents),
        s as (
            select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
            from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)
        ),
        n as (select doc_id, count(*) as n from s group by doc_id),
        shared as (select a.doc_id as x, b.doc_id as y, count(*) as k from s as a join s as b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
        p as (select x, y from shared join n as a on a.doc_id = x join n as b on b.doc_id = y where k >= 0.8 * (a.n + b.n - k) - 1e-9),
        reach as (
            select doc_id as x, doc_id as y from documents
            union
            select reach.x, p.y from reach join p on reach.y = p.x
        ),
        links as (select x, count(*) as k from p group by x)
        select r.x as doc_id, min(r.y) as class_id, coalesce(any_value(k), 0) as n_links, r.x = min(r.y) as kept
        from reach as r left join links on links.x = r.x group by r.x""",
    "op9_substring_dedup": f"""
        with d as (select doc_id, {_WORDS} as w from documents),
        win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
        first as (select s, min(doc_id) as least from win group by s),
        gone as (select distinct doc_id, unnest(range(i, i + 13)) as k from win join first on first.s = win.s where least < doc_id),
        words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as k from d),
        kept as (
            select doc_id, count(*) as n, string_agg(word, ' ' order by k) as t from words
            where not exists (select 1 from gone where gone.doc_id = words.doc_id and gone.k = words.k) group by doc_id
        )
        select d.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
        from d left join kept on kept.doc_id = d.doc_id""",
    "op2_nearest_vectors": f"""
        with v as ({_VECTORS}),
        d as (
            select q.vec_id as query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.embedding, c.embedding),
                lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)), lambda p, q: p + q)) as score
            from v as q join v as c on q.vec_id <> c.vec_id and len(q.embedding) = len(c.embedding)
            where q.vec_id % 100 = 0
        ),
        r as (select *, row_number() over (partition by query_id order by score, vec_id) as place from d)
        select query_id, cast(place as integer) as rank, vec_id, score from r where place <= 10""",
    "op8_near_vectors": f"""
        with recursive v as (select * from ({_VECTORS}) where label is not null),
        p as (
            select a.vec_id as x, b.vec_id as y from v as a join v as b on a.label = b.label and a.vec_id <> b.vec_id
                and len(a.embedding) = len(b.embedding)
            where {_DOT.format("a", "b")} / (sqrt({_DOT.format("a", "a")}) * sqrt({_DOT.format("b", "b")})) >= 0.98
        ),
        reach as (
            select vec_id as x, vec_id as y from embeddings
            union
            select reach.x, p.y from reach join p on reach.y = p.x
        )
        select e.vec_id, (select count(*) from p where p.x = e.vec_id) as n_links, min(reach.y) as component_id,
            e.vec_id = min(reach.y) as kept
        from embeddings as e join reach on reach.x = e.vec_id
        group by e.vec_id""",
    "op13_hard_negatives": """
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                list_transform(embedding, lambda x: floor(256 * x::double)) as code
            from embeddings where label is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
        ),
        s as (
            select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
                cast(list_reduce(list_transform(list_zip(a.code, c.code), lambda z: z[1] * z[2]), lambda p, q: p + q) as bigint) as score
            from v as a join v as c on a.vec_id <> c.vec_id and len(a.code) = len(c.code) where a.vec_id % 100 = 0
        ),
        p as (
            select anchor_id, vec_id as positive_id, score as positive_score from s where same
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
        ),
        n as (
            select p.*, s.vec_id as negative_id, s.score as negative_score,
                row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as place
            from p join s on s.anchor_id = p.anchor_id and not same
            where 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
        )
        select anchor_id, positive_id, cast(place as integer) as rank, negative_id, positive_score, negative_score from n where place <= 10""",
}
