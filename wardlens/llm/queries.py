"""One query for each operator: over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm import chat, collocation, encoding, exactdup, infill, jaccard, langid, lzprint, quality, tiling, tokencount, tokenfiles, warc
from wardlens.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
QUALITY_CUT = 0.3
CONTEXT = 4096


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def language_model(docs: DataFrame) -> langid.LanguageModel:
    return langid.fit(docs.where(fold(4) != 2), "text", "lang", "doc_id")


def language_vocabulary(docs: DataFrame) -> dict:
    return langid.vocabulary(docs.where(fold(4) != 2), "text", "lang", "doc_id")


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.QualityModel:
    """Ids and labels meet first, so that only labelled texts are read into the join."""
    learn = labels.select("doc_id", "quality").where(fold(5) != 0)
    return quality.fit(docs.select("doc_id", "text").join(learn, "doc_id"), "text", "quality", "doc_id")


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(language_model(docs), F.col("text"))
    held = F.coalesce(fold(4) == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score"
    )


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = tiling.blocks(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return docs.select("doc_id", tiling.contamination(items, F.col("text")).alias("own")).select(
        "doc_id", (F.col("own.n_items") > 0).alias("contaminated"), "own.*"
    )


@query
def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(fold(5) == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), quality.score(model, F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= QUALITY_CUT).cast("int")
    )


@query
def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return docs.select("doc_id", encoding.digests(F.col("text"), path).alias("own")).select("doc_id", "own.*")


@query
def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("piece_bpe_32k.model")
    counted = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(tokencount.count_tokens(F.col("text"), path), F.lit(0)).cast("long").alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > CONTEXT)


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    files = tokenfiles.write(docs, "doc_id", "text", path, scratch_path(spark, "tokens"), end_id=2)
    return tokenfiles.read(spark, files).withColumnRenamed("key", "doc_id")


@query
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.join(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query
def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"), "page_id", "url", "html", scratch_path(spark, "warc"))
    return warc.read(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    folder = scratch_path(spark, "chat")
    chat.write(rows, "conv_id", "turn", "role", "text", folder)
    return chat.read(spark, folder)


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents").select("text", "lang"), "text", "lang")


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = docs.select("doc_id", infill.fill_in_middle(F.col("text"), infill.draws(F.col("doc_id"))).alias("own")).select("doc_id", "own.*")
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdup.members(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return found.select(
        F.col("key").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("digest").alias("text_sha256")
    )


_MARKS = r"(\\|</?s>|\[/?INST\]|<</?SYS>>)"
SQL["op6_chat_tree"] = rf"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    cast(sum(8 + length(replace(regexp_replace(role, '{_MARKS}', '\\\1', 'g'), chr(10), '\' || chr(10)))
        + length(regexp_replace(text, '{_MARKS}', '\\\1', 'g'))) as bigint) as formatted_chars
from turns group by conv_id
"""


SQL["op5_warc_zip"] = """
with digests as (
    select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as digest,
        min(page_id) over (partition by sha1(coalesce(html, ''))) as first_page
    from pages
), bits as (
    select *, cast(cast(unhex(digest) as bit) as varchar) as bits from digests
)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + 16 * cast(substr(bits, i * 5 + 1, 1) as integer) + 8 * cast(substr(bits, i * 5 + 2, 1) as integer)
        + 4 * cast(substr(bits, i * 5 + 3, 1) as integer) + 2 * cast(substr(bits, i * 5 + 4, 1) as integer)
        + cast(substr(bits, i * 5 + 5, 1) as integer), 1)), '') as payload_digest,
    case when page_id > first_page then 'revisit' else 'response' end as record_type,
    case when page_id > first_page then first_page end as refers_to
from bits
"""

SQL["op3_ngram_jaccard"] = r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
), places as (
    select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from words where len(w) > 0
), shingles as (
    select distinct doc_id, array_to_string(w[k:k + 4], ' ') as s from places
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), shared as (
    select a.doc_id as one, b.doc_id as two, count(*) as n
    from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), links as (
    select one, two from shared
    join sizes x on x.doc_id = one join sizes y on y.doc_id = two
    where 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), ways as (
    select one, two from links union all select two, one from links
), reached as (
    select doc_id, doc_id as least from documents
    union
    select two, least from reached join ways on one = doc_id
)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id
from documents d left join sizes s on s.doc_id = d.doc_id
join (select doc_id, min(least) as component_id from reached group by doc_id) r on r.doc_id = d.doc_id
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op13_exact_dedup"] = f"""
with named as (
    select doc_id, {_LOWERED} as text from documents
)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
    doc_id = max(doc_id) over same as kept, sha256(text) as text_sha256
from named window same as (partition by text)
"""

SQL["op12_fill_in_middle"] = """
with drawn as (
    select doc_id, coalesce(text, '') as text, cast(length(coalesce(text, '')) as bigint) as n, sha256('1:' || doc_id) as h from documents
), numbers as (
    select doc_id, text, n, cast('0x' || h[1:8] as bigint) % (n + 1) as one, cast('0x' || h[9:16] as bigint) % (n + 1) as two,
        cast('0x' || h[17:24] as bigint) % 100 as three, cast('0x' || h[25:32] as bigint) % 100 as four
    from drawn
), cuts as (
    select *, least(one, two) as p, greatest(one, two) as m,
        case when n = 0 or text like '%<P>%' or text like '%<S>%' or text like '%<M>%' or three >= 90 then 'plain'
            when four < 20 then 'spm' else 'psm' end as form
    from numbers
), pieces as (
    select *, substring(text, 1, p) as prefix, substring(text, p + 1, m - p) as middle, substring(text, m + 1) as suffix from cuts
)
select doc_id, n, form, case when form <> 'plain' then p end as prefix_chars, case when form <> 'plain' then m - p end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(text) as restored_sha256
from pieces
"""

SQL["op11_collocations"] = rf"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) as piece from documents
), words as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), totals as (
    select lang, cast(sum(len(w)) as bigint) as n from words group by lang
), places as (
    select lang, w, m, unnest(range(1, len(w) - m + 2)) as k from words, (values (1), (2), (3), (4)) sizes(m) where len(w) >= m
), phrases as (
    select lang, w[k:k + m - 1] as p, count(*) as a from places group by lang, p having count(*) >= 30
), cuts as (
    select lang, p, a, unnest(range(1, len(p))) as k from phrases
), parted as (
    select c.lang, c.p, c.a, k, x.a as l, y.a as r, cast(2000000::hugeint * c.a // (x.a::hugeint + y.a) as bigint) as score
    from cuts c join phrases x on x.lang = c.lang and x.p = c.p[1:k] join phrases y on y.lang = c.lang and y.p = c.p[k + 1:]
), lowest as (
    select * from parted qualify row_number() over (partition by lang, p order by score, k) = 1
), spans as (
    select lang, p, a, i, unnest(range(i + 1, len(p) + 1)) as j from (select *, unnest(range(1, len(p))) as i from phrases where len(p) > 2)
), inside as (
    select lang, p[i:j] as p, max(a) as more from spans where j - i + 1 < len(p) group by lang, p[i:j]
), kept as (
    select b.lang, array_to_string(b.p, ' ') as phrase, a, l, r, score
    from lowest b left join inside i on i.lang = b.lang and i.p = b.p
    where more is null or 100::hugeint * more < 80::hugeint * a
)
select kept.lang, row_number() over (partition by kept.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join totals on totals.lang = kept.lang
qualify rank <= 2000
"""
