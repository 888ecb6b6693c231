"""The operators with production parameters, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skygauge.llm import (
    chat_format,
    decontamination,
    html_extract,
    line_dedup,
    mixing,
    order_minhash,
    quality_rules,
    sharding,
    simhash,
    spelling,
    token_counts,
    url_filter,
    whitening,
)
from skygauge.llm.registry import ORACLE, QUERIES, query, table

__all__ = ["ORACLE", "QUERIES"]

#: File of the public tokenizer whose tokens are counted.
TOKENIZER = "word_bpe_49k.json"

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

_HASH = (
    "cast('0x' || substr(md5(concat_ws('|', coalesce('=' || doc_id, '-'), coalesce('=' || text, '-'))), 1, 15) as bigint)"
)


@query("op1_text_density")
def text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op2_quality_rules")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", *quality_rules.STATS, "base_failed", "kept", "rule")


_MIX = f"""
with docs as (
  select doc_id, source, {_HASH} as h,
         cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size
  from documents),
sizes as (select source, cast(sum(size) as bigint) as s from docs group by source),
ranked as (
  select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as w from sizes),
summed as (
  select *, sum(s) over () as total, sum(w) over () as ws,
         coalesce(sum(3 * s) over before, 0) as capped, coalesce(sum(w) over before, 0) as used,
         row_number() over (order by cast(3 * s as double) / w, source nulls last) as k
  from ranked
  window before as (order by cast(3 * s as double) / w, source nulls last rows between unbounded preceding and 1 preceding)),
levels as (select *, cast(total - capped as double) / cast(ws - used as double) as l from summed),
cut as (select min(k) as k from levels where l * w <= 3 * s),
targets as (
  select source, s as source_size,
         case when levels.k >= cut.k then (select l from levels, cut where levels.k = cut.k) * w else 3.0 * s end as target
  from levels, cut),
plans as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as repeats from targets),
upto as (
  select source, h, sum(size) as n, sum(sum(size)) over (partition by source order by h) as upto from docs group by source, h),
edges as (
  select p.source, min(u.h) as threshold
  from plans p join upto u on p.source is not distinct from u.source
  where u.upto > p.target - p.repeats * p.source_size group by p.source),
lefts as (
  select p.*, coalesce(e.threshold, 1152921504606846976) as threshold,
         p.target - p.repeats * p.source_size - coalesce(
           (select max(u.upto) from upto u where u.source is not distinct from p.source
            and u.h < coalesce(e.threshold, 1152921504606846976)), 0) as rest
  from plans p left join edges e on p.source is not distinct from e.source),
closing as (
  select l.source, arg_min(u.h, struct_pack(off := abs(u.n - l.rest), h := u.h)) as closing
  from lefts l join upto u on l.source is not distinct from u.source
  where u.h >= l.threshold and u.n > 0 and abs(u.n - l.rest) < l.rest group by l.source)
select d.doc_id, d.size, l.source_size, l.target,
       cast(case when d.size = 0 then 0 else
         d.size * least(3, l.repeats + case when d.h < l.threshold or d.h = c.closing then 1 else 0 end) end as bigint) as taken
from docs d join lefts l on d.source is not distinct from l.source
left join closing c on d.source is not distinct from c.source
"""


@query("op3_source_mix", _MIX)
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


_ROTATE = """
with said as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker,
         replace(coalesce(text, ''), '<|', '<\\|') as words from conversations),
speakers as (select distinct conv_id, speaker as perspective from said where speaker <> 'system'),
roles as (
  select s.conv_id, p.perspective, s.turn, s.speaker, s.words,
         case when s.speaker = 'system' then 'system' when s.speaker = p.perspective then 'assistant' else 'user' end as chat_role
  from said s left join speakers p on s.conv_id is not distinct from p.conv_id),
opened as (
  select *, case when chat_role = 'user'
    then '<|user name=' || replace(replace(replace(speaker, '<|', '<\\|'), '|>', '\\|>'), chr(10), ' ') || '|>'
    else '<|' || chat_role || '|>' end as opening from roles)
select conv_id, perspective, turn, speaker, chat_role, opening || words || '<|end|>' as segment,
       chat_role = 'assistant' as train, cast(length(opening) as bigint) as train_from,
       cast(length(opening) + case when chat_role = 'assistant' then length(words) + 7 else 0 end as bigint) as train_to
from opened
"""


@query("op4_perspective_rotation", _ROTATE)
def perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(table(spark, sf_dir, "conversations"))


@query("op5_aligned_lines")
def aligned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


_SHARD = f"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(strlen(text), 0) as n_bytes, {_HASH} as h from documents),
sums as (
  select d, h >> (60 - d) as p, sum(n_bytes) as b from docs, range(61) t(d) group by all),
leaf as (
  select r, min(s.d) as d, arg_min(s.b, s.d) as b
  from docs join sums s on s.p = docs.h >> (60 - s.d) and (s.b <= {sharding.LIMIT_BYTES} or s.d = 60) group by r)
select doc_id, n_bytes, substr(lpad(bin(h), 60, '0'), 1, d) as shard, cast(b as bigint) as shard_bytes,
       b <= {sharding.LIMIT_BYTES} as fits
from docs join leaf using (r)
"""


@query("op6_extendible_shards", _SHARD)
def extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "shard", "shard_bytes", "fits")


@query("op7_benchmark_matches")
def benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", *decontamination.question_and_answer())
    return decontamination.matches(table(spark, sf_dir, "documents"), items)


@query("op8_token_counts")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path(TOKENIZER))


_URL = """
with parts as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path
  from pages),
judged as (
  select *, case
    when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule
  from parts)
select *, case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict from judged
"""


@query("op9_url_trie", _URL)
def url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op10_simhash_components")
def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.exact_groups(table(spark, sf_dir, "documents"))


@query("op11_order_minhash")
def order_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


_SPELL = """
with recursive runs as (
  select coalesce(cast(doc_id as varchar), '') as id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[A-Za-z\u00C0-\u00FF]+')) as run from documents),
uses as (select id, run, count(*) as times from runs group by all),
bytes as (
  select *, flatten(list_transform(string_split(id || ':' || run, ''), lambda ch:
    case when unicode(ch) < 128 then [unicode(ch)] else [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)] end)) as b from uses),
hashed as (
  select run, times, xor(list_reduce(
    list_prepend(4294967295, flatten(list_transform(b, lambda x: list_transform(range(8), lambda k: cast((x >> k) & 1 as bigint))))),
    lambda c, bit: xor(c >> 1, 3988292384 * (xor(c, bit) & 1))), 4294967295) as h from bytes),
typed as (
  select case when h % 199 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, times
  from hashed),
words as (
  select word, cast(sum(times) as bigint) as n from typed where length(word) >= 6 group by word having sum(times) >= 5),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
rests as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from places),
near as (
  select r.word as a, w.word as b from rests r join words w on r.rest = w.word
  union select w.word, r.word from rests r join words w on r.rest = w.word
  union select x.word, y.word from rests x join rests y on x.i = y.i and x.rest = y.rest and x.word <> y.word),
best as (
  select a, count(*) as n_near, max(w.n) as top, min(struct_pack(less := -w.n, b := b)).b as form
  from near join words w on w.word = b group by a),
formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when top >= 5 * n then form end as form,
         cast(case when top >= 5 * n then top end as bigint) as form_n
  from words w left join best on best.a = w.word),
chain as (
  select word, word as at, form as up from formed
  union all select c.word, f.word, f.form from chain c join formed f on f.word = c.up)
select f.word, f.form, c.at as root, f.n, cast(f.n_near as bigint) as n_near, f.form_n
from formed f join chain c on c.word = f.word and c.up is null
"""


@query("op13_spelling_variants", _SPELL)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


@query("op12_lanczos_whitening")
def lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
