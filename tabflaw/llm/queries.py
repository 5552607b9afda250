"""The opN queries over the driver tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import ann, collocations, decontam, dialogues, langid, licenses, mixing, quality, secrets, shards, simhash, tokens, warc
from .common import prepare

TOKEN_LIMIT = 512


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    prepare(spark)
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by hyperdimensional profiles."""
    return langid.identify(_documents(spark, sf_dir, "lang"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-pair token counts of every document."""
    from public_tokenizers import path
    return tokens.token_counts(_documents(spark, sf_dir), path("byte_bpe_50k.json"), TOKEN_LIMIT)


def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in Zstandard archives with a leading dictionary, read back and checked."""
    prepare(spark)
    return warc.round_trip(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents by multi-index hashing."""
    return simhash.near_duplicates(_documents(spark, sf_dir), size=3, distance=2)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: fixed patterns and strings that a vocabulary cannot shorten."""
    from public_tokenizers import PATTERN, path
    return secrets.secret_scan(_documents(spark, sf_dir), path("byte_bpe_50k.tiktoken"), PATTERN)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document by a generalised suffix automaton."""
    return decontam.contamination(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark").select("item_id", "text"),
                                  window=10)


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes over fixed virtual slots."""
    return shards.shard(_documents(spark, sf_dir), shards=16)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences stated in every document, by conditional compression and exact wording."""
    return licenses.license_scan(_documents(spark, sf_dir))


def op9_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, by pivotal rounding."""
    return mixing.mix(_documents(spark, sf_dir, "source")).drop("key")


def op10_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all, over learned partitions."""
    prepare(spark)
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after the test damage: its faults, its cheapest repair and the digest of the result."""
    prepare(spark)
    return dialogues.repair_report(dialogues.damage(read_table(spark, sf_dir, "conversations")), alive="alive")


def op12_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by naive Bayes support vectors, learned from the labelled ones."""
    return quality.classify(_documents(spark, sf_dir), read_table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 collocations by SON partitioning."""
    return collocations.collocations(_documents(spark, sf_dir, "lang"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_token_counts, op3_warc_archives, op4_simhash_duplicates, op5_secret_scan, op6_decontamination,
    op7_virtual_slots, op8_license_scan, op9_pivotal_mix, op10_learned_partitions, op11_conversation_repair, op12_quality_scores, op13_collocations)}

#: base 32 of a SHA-1: five hexadecimal digits are four characters
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(sha, {1 + 5 * g}, 5) as integer) >> {s}) & 31), 1)"
    for g in range(8) for s in (15, 10, 5, 0))

ORACLES: dict[str, str] = {
    "op3_warc_archives": f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as sha from pages),
t as (select sha, max(page_id) as top from p group by sha)
select p.page_id, cast(p.n as bigint) as payload_bytes, {_BASE32} as payload_digest,
  case when p.page_id = t.top then 'response' else 'revisit' end as record_type,
  case when p.page_id <> t.top then t.top end as refers_to
from p join t using (sha)""",
    "op6_decontamination": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bw as (select distinct item, k, array_to_string(ws[i + 1 : i + k], ' ') as w
  from (select item, ws, least(10, len(ws)) as k, unnest(range(len(ws) - least(10, len(ws)) + 1)) as i from b where len(ws) > 0)),
sizes as (select distinct k from bw),
dw as (select doc_id, i, k, array_to_string(ws[i + 1 : i + k], ' ') as w
  from (select doc_id, ws, k, unnest(range(len(ws) - k + 1)) as i from d, sizes where len(ws) >= k)),
hits as (select doc_id, i, dw.k, item from dw join bw on dw.w = bw.w and dw.k = bw.k),
hitpos as (select distinct doc_id, unnest(range(i, i + k)) as p from hits),
names as (select doc_id, count(distinct item) as n, string_agg(distinct item, ',' order by item) as items from hits group by doc_id),
n as (select doc_id, count(*) as n_hit from hitpos group by doc_id),
runs as (select doc_id, min(p) as s, max(p) + 1 as e from (select doc_id, p, p - row_number() over (partition by doc_id order by p) as g from hitpos)
  group by doc_id, g),
spans as (select doc_id, string_agg(s || ':' || e, ',' order by s) as spans from runs group by doc_id)
select d.doc_id, cast(len(d.ws) as bigint) as n_words, coalesce(n.n_hit, 0) as n_hit, coalesce(names.n, 0) as n_items,
  sha256(coalesce(names.items, '')) as items_sha256, coalesce(n.n_hit, 0) > 0 as contaminated, coalesce(spans.spans, '') as spans
from d left join n using (doc_id) left join names using (doc_id) left join spans using (doc_id)""",
    "op13_collocations": r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
n as (select lang, cast(sum(len(ws)) as bigint) as n from w group by lang),
g as (select lang, k, array_to_string(ws[i + 1 : i + k], ' ') as phrase
  from (select lang, ws, k, unnest(range(len(ws) - k + 1)) as i from w, range(1, 6) t(k) where len(ws) >= k)),
f as (select lang, k, phrase, count(*) as f, string_split(phrase, ' ') as ws from g group by lang, k, phrase having count(*) >= 100),
cuts as (select lang, phrase, k, f as a, cut, array_to_string(ws[1 : cut], ' ') as x, array_to_string(ws[cut + 1 : k], ' ') as y
  from (select *, unnest(range(1, k)) as cut from f where k > 1)),
scored as (select c.lang, c.phrase, c.a, x.f as l, y.f as r, n.n, cut,
    cast((cast(1000 as hugeint) * c.a * n.n) // (cast(x.f as hugeint) * y.f) as bigint) as score
  from cuts c join f x on x.lang = c.lang and x.phrase = c.x join f y on y.lang = c.lang and y.phrase = c.y join n on n.lang = c.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
subs as (select lang, array_to_string(ws[i + 1 : i + j], ' ') as phrase, f
  from (select lang, ws, f, j, unnest(range(k - j + 1)) as i from (select *, unnest(range(2, k)) as j from f where k > 2))),
inside as (select lang, phrase, max(f) as longer from subs group by lang, phrase)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank, b.phrase, a, l, r, n, score
from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase where longer is null or longer < a
qualify rank <= 2000""",
}
