"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, langid, license, mixing, neardup, packing, pii, quality, urltree, warc
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edits(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classify(table(spark, sf_dir, "documents"))


_NEARDUP_SQL = """
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as sh from g),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
e as (select x, y from l union all select y, x from l),
r(x, y) as (select doc_id, doc_id from d union select r.x, e.y from r join e on r.y = e.x),
c as (select x as doc_id, min(y) as component_id from r group by x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept from d join c using (doc_id) left join n using (doc_id)"""


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(table(spark, sf_dir, "pages"), RULES)


_URL_SQL = f"""
with recursive u as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r as (select *, case when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/' when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
  when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/' when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule from h),
v as (select *, case rule when 'example.com/de/' then 'block' when 'net/' then 'block' when 'example.net/en/' then 'allow' when 'org/fr/' then 'allow' end as ruling from r),
p as (select host, path, count(ruling) as labelled, count(*) filter (where ruling = 'block') as blocked from v group by host, path),
s0 as (select *, list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda x: case when regexp_matches(x, '^[0-9a-fA-F-]{{16,}}$') then '{{h}}' else regexp_replace(x, '[0-9]+', '{{n}}', 'g') end) as seg from p),
t(host, path, labelled, blocked, seg, depth, node, above, next) as (
  select host, path, labelled, blocked, seg, 0, '', (select coalesce(sum(blocked)::double / nullif(sum(labelled), 0), 0) from p), seg[1] from s0
  union all
  (with c as (select host, node, next, sum(labelled) as l, sum(blocked) as b from t where depth >= 0 group by all),
  f as (select host, node, count(*) as branches, sum(l)::double as al, sum(b)::double as ab,
      coalesce(sum(l) filter (where next is not null), 0)::double as cl, coalesce(sum(b) filter (where next is not null), 0)::double as cb,
      count(*) filter (where next is not null and l >= {urltree.MIN_LABELS}) as known, count(*) filter (where next is not null and l < {urltree.MIN_LABELS}) as unknown from c group by host, node),
  g as (select c.host, c.node, c.next, branches, al, ab, case when l < {urltree.MIN_LABELS} and unknown > {urltree.MAX_CHILDREN} then '{{*}}'
        when l >= {urltree.MIN_LABELS} and known > 1 and (b * cl - cb * l) * (b * cl - cb * l) <= {urltree.CHI2}::double * cb * (cl - cb) * l::double then '{{~}}' else c.next end as label
      from c join f on c.host = f.host and c.node = f.node)
  select t.host, path, labelled, blocked, seg, case when t.next is null then -1 else depth + 1 end, case when t.next is null then t.node else t.node || '/' || label end,
    case when branches > 1 then (ab + {urltree.PRIOR_WEIGHT}::double * above) / (al + {urltree.PRIOR_WEIGHT}::double) else above end, case when t.next is null then null else seg[depth + 2] end
    from t join g on t.host = g.host and t.node = g.node and t.next is not distinct from g.next where depth >= 0)),
done as (select host, path, labelled, blocked, substr(node, 2) as template, above from t where depth < 0),
j as (select host, template, case when sum(labelled) >= {urltree.MIN_LABELS} and (sum(blocked)::double + {urltree.PRIOR_WEIGHT}::double * max(above)) / (sum(labelled)::double + {urltree.PRIOR_WEIGHT}::double) >= {urltree.PURITY}::double then 'block' else 'allow' end as learnt from done group by all)
select page_id, v.host, v.path, rule, done.template, coalesce(ruling, learnt) as verdict from v join done on v.host = done.host and v.path = done.path join j on j.host = done.host and j.template = done.template"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_WARC_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as x, min(page_id) over (partition by sha1(h)) as first from p),
g as (select *, list_transform(range(8), lambda i: ('0x' || substr(x, 1 + 5 * i, 5))::bigint) as v from d)
select page_id, payload_bytes,
  array_to_string(flatten(list_transform(v, lambda b: list_transform([32768, 1024, 32, 1], lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((b // q) % 32)::int, 1)))), '') as payload_digest,
  case when page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from g"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def _quality_sql() -> str:
    covered = ", ".join(f"coalesce(sum(wc) filter (where c{n}), 0)::bigint as covered_{n}" for n in quality.MAX_COVERED)
    grams = ", ".join(f"case when pos + {n} <= n then list_aggregate(w[pos + 1:pos + {n}], 'string_agg', ' ') end as g{n}" for n in quality.MAX_COVERED)
    twice = ", ".join(f"g{n} is not null and count(*) over (partition by r, g{n}) > 1 as d{n}" for n in quality.MAX_COVERED)
    spread = ", ".join(f"bool_or(d{n}) over (partition by r order by pos rows between {n - 1} preceding and current row) as c{n}" for n in quality.MAX_COVERED)
    bad = " or ".join(f"100 * covered_{n} > {most} * word_chars" for n, most in quality.MAX_COVERED.items())
    names = ", ".join(f"coalesce(covered_{n}, 0)::bigint as covered_{n}" for n in quality.MAX_COVERED)
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from d),
p as (select r, w, len(w) as n, unnest(range(len(w)))::bigint as pos from w),
g as (select r, pos, length(w[pos + 1]) as wc, {grams} from p),
t2 as (select r, pos, wc, {twice} from g),
c as (select r, wc, {spread} from t2),
s as (select r, coalesce(sum(wc), 0)::bigint as word_chars, count(*) filter (where c8) as n_repeat_words, {covered} from c group by r),
l as (select r, unnest(string_split(t, chr(10))) as line from d),
l2 as (select r, line, count(*) - 1 as again from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by r, line having count(*) > 1),
l3 as (select r, sum(again)::bigint as n_dup_lines, sum(again * length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')))::bigint as dup_line_chars from l2 group by r),
m as (select doc_id, len(w)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(dup_line_chars, 0)::bigint as dup_line_chars, {names}
  from w left join s using (r) left join l3 using (r)),
f as (select *, n_words < {quality.BASE_MIN_WORDS} or 100 * n_repeat_words > {quality.BASE_MAX_REPEAT} * n_words as base_failed from m)
select *, not base_failed and not ({bad} or 100 * dup_line_chars > {quality.MAX_LINE_CHARS} * word_chars) as kept from f"""


QUERIES = {"op1_packing": op1_packing, "op2_mixing": op2_mixing, "op3_fingerprint": op3_fingerprint, "op4_langid": op4_langid, "op5_neardup": op5_neardup, "op6_urls": op6_urls, "op7_pii": op7_pii, "op8_license": op8_license, "op9_warc": op9_warc, "op10_quality": op10_quality}
ORACLES = {"op6_urls": _URL_SQL, "op5_neardup": _NEARDUP_SQL, "op9_warc": _WARC_SQL, "op10_quality": _quality_sql()}
