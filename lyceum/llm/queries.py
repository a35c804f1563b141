"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lyceum.llm import chroma, fingerprint, langid, minhash_dedup, mixing, packing, pii, quality, sharding, url_filter
from lyceum.session import prepare, table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return minhash_dedup.near_duplicates(table(prepare(spark), sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from weak labels."""
    return quality.classify(table(prepare(spark), sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a tree of 40 shards, law `key`."""
    return sharding.shard_rows(table(prepare(spark), sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of 2048."""
    return packing.pack(table(prepare(spark), sf_dir, "documents"))


def op5_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a recording, with its fingerprint and the query that aligns best with it."""
    return chroma.match_recordings(chroma.recordings(table(prepare(spark), sf_dir, "embeddings")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL, by rules and by the list of syndicated URLs."""
    pages = table(prepare(spark), sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.feed_urls(pages))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return mixing.mix(table(prepare(spark), sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    return pii.personal_data(table(prepare(spark), sf_dir, "documents"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text."""
    return fingerprint.fingerprint_rows(table(prepare(spark), sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text."""
    return langid.identify(table(prepare(spark), sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_duplicates, op2_quality, op3_sharding, op4_packing, op5_chroma,
        op6_url_filter, op7_mixing, op8_personal_data, op9_fingerprint, op10_language,
    )
}

ORACLE = {
    "op1_near_duplicates": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as shingle
  from w
), n as (
  select doc_id, count(*)::bigint as n from s group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as both from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2
), l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * p.both >= 75 * (x.n + y.n - p.both)
), r as (
  select doc_id, doc_id as other from documents union select r.doc_id, l.b from r join l on l.a = r.other
)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, w.doc_id = c.component_id as kept
from w left join n using (doc_id) join (select doc_id, min(other) as component_id from r group by doc_id) c using (doc_id)
""",
    "op3_sharding": r"""
with recursive t as (
  select i, i as c, 0 as step from range(0, 256) x(i)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, step + 1 from t where step < 8
), crc as (
  select list(c order by i) as tab from t where step = 8
), d as (
  select doc_id, (coalesce(octet_length(encode(text)), 0) + 16)::bigint as size, coalesce(doc_id::varchar, '') as key,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::bigint)::bigint as text_crc32
  from documents, crc
), g as (
  select d.*, list_transform(range(0, 41), lambda i: -ln((('0x' || substr(md5(key || '/g' || case when i = 40 then 40 else i % 2 end), 1, 13))::bigint + 0.5) / 4503599627370496.0) / case when i = 40 then 1.0 else 20.0 end) as u from d
), r as (
  select *, case when u[1] < u[2] then 0 else 1 end as region from g
), k as (
  select *, list_transform(range(0, 4), lambda i: -ln((('0x' || substr(md5(key || '/g' || region || 'r' || (4 * region + i)), 1, 13))::bigint + 0.5) / 4503599627370496.0) / 5.0) as v from r
), a as (
  select *, 4 * region + list_position(v, list_min(v)) - 1 as rack from k
), s as (
  select *, list_transform(range(0, 5), lambda i: -ln((('0x' || substr(md5(key || '/' || (5 * rack + i)), 1, 13))::bigint + 0.5) / 4503599627370496.0) / 1.0) as w from a
), c as (
  select *, (5 * rack + list_position(w, list_min(w)) - 1)::integer as shard from s
)
select doc_id, size, text_crc32, 'key' as law, shard, (row_number() over (partition by shard order by md5(key), doc_id) - 1)::bigint as slot,
  case when u[41] < least(u[1], u[2]) then 40 else shard end as grown_shard
from c
""",
    "op6_url_filter": r"""
with u as (
  select page_id, url,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), c as (
  select *, case when host <> '' then regexp_replace(regexp_replace(host, '\.?(:80|:443)?$', ''), '^www\.', '') || regexp_replace(path, '(\.html?)?/*$', '') end as canon,
    case when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
         when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
         when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
         when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule
  from u
), listed as (
  select distinct canon from c where canon is not null and regexp_matches(url, '[?&]utm_source=feed(&|#|$)')
)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
       when canon in (select canon from listed) then 'block' else 'allow' end as verdict
from c
""",
    "op7_mixing": r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as key
  from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, row_number() over (order by source nulls last) - 1 as rank from s
), v as (
  select *, case rank % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight from w
), o as (
  select *, sum(source_size) over ()::bigint as total,
    coalesce(sum(source_size) over (order by source_size / weight, rank rows between unbounded preceding and 1 preceding), 0)::bigint as before,
    sum(weight) over (order by source_size / weight, rank rows between current row and unbounded following) as remaining,
    row_number() over (order by source_size / weight, rank) as pos
  from v
), l as (
  select *, ((150 * total - 200 * before) / 100.0::double) / remaining as level from o
), t as (
  select source, source_size, coalesce(least(2.0::double * source_size, weight * (select arg_min(level, pos) from l where weight * level < 2.0::double * source_size)), 2.0::double * source_size) as target from l
), p as (
  select doc_id, size, source, coalesce(sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d
), j as (
  select p.doc_id, p.size, t.source_size, t.target, p.start, floor(t.target + 1e-9)::bigint as budget
  from p join t on p.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (case when source_size > 0 then budget // source_size else 0 end * size
   + greatest(0, least(size, budget - (case when source_size > 0 then budget // source_size else 0 end) * source_size - start)))::bigint as taken
from j
""",
}
