"""The registered queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, conversation_repair, exact_dedup, jaccard, language_id, lexical_search, lm, mixing, ogg, quality_outliers, tool_calls, toxicity, url_filter
from quern.llm.common import crc_bucket

#: Where the rank file is; a parameter, never copied.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def chat_tables(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tool calls, results and schemas from plain conversations: a user turn calls a tool and depends on the user turn two before, the next
    assistant turn is its result. Some calls are faulty: limits of the wrong type or too large, no query, languages and tags that the schemas don't
    allow; some are left out, so that their results are orphans; in some conversations the first call depends on the third."""
    t = conversations.select("conv_id", "turn", "role", "text")
    c, turn = F.col("conv_id"), F.col("turn")
    name = F.get(F.array(F.lit("search"), F.lit("lookup"), F.lit("summarise")), (turn % 3).cast("int"))
    ident = lambda n: F.concat(c.cast("string"), F.lit("-"), n.cast("string"))
    query = F.when((c % 6 == 1) & (turn == 2), "").otherwise(F.concat(F.regexp_extract(F.to_json(F.struct(F.col("text").alias("query"))), r"(?s)^\{(.*)\}$", 1), F.lit(",")))
    limit = F.when(turn % 5 == 4, F.concat(F.lit('"'), turn.cast("string"), F.lit('"'))).when((c % 7 == 2) & (turn == 0), "1000").otherwise(turn.cast("string"))
    lang, tag = F.when(c % 5 == 3, "xx").otherwise("en"), F.when(c % 9 == 7, "5").otherwise('"b"')
    arguments = F.concat(F.lit("{"), query, F.lit('"limit":'), limit, F.lit(',"filter":{"tags":["a",'), tag, F.lit('],"lang":"'), lang, F.lit('"}}'))
    parent = F.when((c % 11 == 5) & (turn == 0), F.lit(4).cast("long")).otherwise(turn - 2)
    calls = t.where("role = 'user' and not (conv_id % 13 = 4 and turn = 2)").select("conv_id", ident(turn).alias("call_id"), ident(parent).alias("parent_id"), turn.alias("seq"), name.alias("name"), arguments.alias("arguments"))
    results = t.where("role = 'assistant'").select("conv_id", ident(turn - 1).alias("call_id"), turn.alias("seq"), F.col("text").alias("content"))
    fields = [("query", "string", True, None, None), ("limit", "integer", True, None, 500.0), ("lang", "string", False, None, None), ("filter", "object", True, None, None), ("filter.lang", "string", True, ["en", "de"], None), ("filter.tags", "array", False, None, None), ("filter.tags[]", "string", False, None, None)]
    rows = [(n, *f) for n in ("search", "lookup", "summarise") for f in fields]
    return calls, results, conversations.sparkSession.createDataFrame(rows, "name string, arg string, type string, required boolean, enum array<string>, maximum double")


def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tool_calls.link(*chat_tables(table(spark, sf_dir, "conversations")))
    return out.withColumn("errors", F.array_join("errors", ","))


def dated_list(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures with a fetch time and dated list entries, from the pages: each page is fetched at a minute of 2024 that
    depends on its id; two thirds of the hosts and their parents are listed, let go and listed again on days
    that depend on their names. Some URLs have blanks before them, a backslash and an @ after the host, or an address for the host; every third
    entry is in capitals with blanks and final dots, and the last two numbers of each address are listed as if they were a domain."""
    number = lambda *x: F.conv(F.substring(F.md5(F.concat(*x).cast("binary")), 1, 8), 16, 10).cast("long")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    page, text = F.col("page_id"), lambda n: (F.col("page_id") % n).cast("string")
    behind = F.regexp_replace("url", r"^(https?://[^/]*)", r"$1\\\\@good.example")
    url = F.when(page % 11 == 0, F.concat(F.lit("http://[2001:DB8::"), text(50), F.lit("]:80/x"))).when(page % 13 == 0, F.concat(F.lit("https://user@10.1."), text(7), F.lit("."), text(5), F.lit("/")))
    url = url.when(page % 7 == 0, F.concat(F.lit(" \t"), "url")).when(page % 5 == 0, behind).otherwise(F.col("url"))
    captures = pages.select("page_id", url.alias("url"), F.timestamp_add("MINUTE", ((F.col("page_id") * 7919) % 525600).cast("int"), start).alias("fetched_at"))
    host = url_filter.host_of(F.col("url"))
    domains = captures.select(F.explode(F.concat(url_filter.suffixes(host), F.when(host.rlike(r"^[\d.]+$"), F.array(F.substring_index(host, ".", -2))).otherwise(F.array()))).alias("domain"))
    domains = domains.where((F.size(F.split("domain", r"\.")) >= 3) | F.col("domain").rlike(r"^[\d.]+$|:")).distinct().where(number(F.col("domain")) % 3 < 2)
    entries = domains.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).withColumn("n", number(F.col("domain"), F.lit("/"), F.col("k").cast("string")))
    category = F.get(F.array(F.lit("ads"), F.lit("malware"), F.lit("spam")), (F.col("n") % 7 % 3).cast("int"))
    spelt = F.when(F.col("n") % 3 == 0, F.concat(F.lit(" "), F.upper("domain"), F.lit(".. "))).otherwise(F.col("domain"))
    return captures, entries.select(spelt.alias("domain"), F.timestamp_add("DAY", (F.col("n") % 366).cast("int"), start).alias("listed_at"), F.when(F.col("k") == 1, "allow").otherwise("block").alias("action"), category.alias("category"))


def op3_url_list_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.evaluate(*dated_list(table(spark, sf_dir, "pages")))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), words=3, percent=90)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = ogg.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return ogg.decode(media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_bucket("doc_id", 4) == 2)
    learned = language_id.dictionaries(docs.where("not held_out"))
    out, margin = language_id.fitted(docs, learned, train=~F.col("held_out"), keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), language_id.told(F.col("lang_margin"), F.col("lang_frame"), margin).alias("accepted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    learned = toxicity.train(*toxicity.sample(labels.where(crc_bucket("doc_id", 4) != 2), docs))
    out = toxicity.score(docs, learned)
    return out.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "log_ratio")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), crc_bucket("doc_id", 5) != 1)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")), gone=F.col("gone"))


def op12_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_outliers.judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_tool_call_linking, op3_url_list_asof, op4_ngram_jaccard, op5_source_mixing, op6_ogg_media, op7_language_id, op8_toxicity, op9_byte_bpe, op10_lm_scoring, op11_conversation_repair, op12_quality_outliers, op13_lexical_search)}

SQL = {
    "op1_exact_dedup": r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents)
select doc_id, min(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
       row_number() over (partition by body order by doc_id nulls last) = 1 as kept, sha256(body) as text_sha256
from n""",
    "op2_tool_call_linking": r"""
with recursive calls as (
  select conv_id, conv_id || '-' || turn as call_id, turn, text, case when conv_id % 11 = 5 and turn = 0 then 4 else turn - 2 end as parent,
         case turn % 3 when 0 then 'search' when 1 then 'lookup' else 'summarise' end as name
  from conversations where role = 'user' and not (conv_id % 13 = 4 and turn = 2)),
placed as (
  select conv_id, turn, 0::bigint as depth from calls c where not exists (select 1 from calls p where p.conv_id = c.conv_id and p.turn = c.parent)
  union all
  select c.conv_id, c.turn, p.depth + 1 from placed p join calls c on c.conv_id = p.conv_id and c.parent = p.turn),
results as (select conv_id, conv_id || '-' || (turn - 1) as call_id, turn, text as content from conversations where role = 'assistant'),
faults as (
  select conv_id, turn, string_agg(e, ',' order by e) as errors
  from (select conv_id, turn, unnest([case when conv_id % 5 = 3 then 'enum:filter.lang' end, case when conv_id % 7 = 2 and turn = 0 then 'maximum:limit' end,
          case when conv_id % 6 = 1 and turn = 2 then 'missing:query' end, case when conv_id % 9 = 7 then 'type:filter.tags[]' end, case when turn % 5 = 4 then 'type:limit' end]) as e from calls)
  where e is not null group by 1, 2)
select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, c.name,
       case when c.call_id is null then 'orphan_result' when p.depth is null then 'cycle' when r.call_id is null then 'no_result' else 'linked' end as status,
       p.depth, coalesce(c.turn, r.turn) as seq,
       c.call_id is not null and p.depth is not null and r.call_id is not null and f.errors is null as valid,
       coalesce(f.errors, '') as errors,
       '{"arguments":' || case when c.call_id is null then 'null'
          else '{"filter":{"lang":"' || case when c.conv_id % 5 = 3 then 'xx' else 'en' end || '","tags":["a",' || case when c.conv_id % 9 = 7 then '5' else '"b"' end || ']},"limit":'
            || case when c.turn % 5 = 4 then '"' || c.turn || '"' when c.conv_id % 7 = 2 and c.turn = 0 then '1000' else c.turn::varchar end
            || case when c.conv_id % 6 = 1 and c.turn = 2 then '' else ',"query":' || to_json(c.text)::varchar end || '}' end
       || ',"id":"' || coalesce(c.call_id, r.call_id) || '","name":' || case when c.name is null then 'null' else '"' || c.name || '"' end
       || ',"result":' || case when r.content is null then 'null' else to_json(r.content)::varchar end || '}' as json
from calls c full outer join results r on c.conv_id = r.conv_id and c.call_id = r.call_id
left join placed p on p.conv_id = c.conv_id and p.turn = c.turn left join faults f on f.conv_id = c.conv_id and f.turn = c.turn""",
    "op3_url_list_asof": r"""
with captures as (
  select page_id, timestamp '2024-01-01' + to_minutes((page_id * 7919) % 525600) as fetched_at,
         case when page_id % 11 = 0 then '2001:db8::' || page_id % 50 when page_id % 13 = 0 then '10.1.' || page_id % 7 || '.' || page_id % 5
              else nullif(regexp_replace(regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '') end as host
  from pages),
hosts as (select distinct host, host similar to '[0-9]+(\.[0-9]+){3}' as is_v4, case when host like '%:%' or host similar to '[0-9]+(\.[0-9]+){3}' then [host] else string_split(host, '.') end as parts from captures where host is not null),
levels as (select host, i - 1 as depth, array_to_string(list_slice(parts, i, len(parts)), '.') as domain
           from hosts, lateral (select unnest(range(1, greatest(len(parts) - 1, 1) + 1)) as i)),
domains as (select distinct domain from (select domain from levels union all select regexp_extract(host, '[0-9]+\.[0-9]+$') from hosts where is_v4)
            where (len(string_split(domain, '.')) >= 3 or domain like '%:%' or domain similar to '[0-9.]+') and ('0x' || substr(md5(domain), 1, 8))::bigint % 3 < 2),
entries as (select domain, k, ('0x' || substr(md5(domain || '/' || k), 1, 8))::bigint as n from domains, range(3) r(k)),
dated as (select domain, timestamp '2024-01-01' + to_days((n % 366)::int) as listed_at,
                 case when k = 1 then 'allow' else 'block' end as action, case n % 7 % 3 when 0 then 'ads' when 1 then 'malware' else 'spam' end as category from entries),
one as (select domain, listed_at, action, category from dated qualify row_number() over (partition by domain, listed_at order by action desc, category desc) = 1),
spans as (select *, lead(listed_at) over (partition by domain order by listed_at) as valid_to from one),
hits as (select c.page_id, l.domain, s.category, s.listed_at, row_number() over (partition by c.page_id order by l.depth) as r
         from captures c join levels l on c.host = l.host join spans s on s.domain = l.domain and s.action = 'block'
           and c.fetched_at >= s.listed_at and (s.valid_to is null or c.fetched_at < s.valid_to))
select c.page_id, c.host, c.fetched_at, h.page_id is not null as blocked, h.domain as matched_domain, h.category, h.listed_at as valid_from
from captures c left join hits h on c.page_id = h.page_id and h.r = 1""",
    "op5_source_mixing": r"""
with sized as (select doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (select *, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight, source_size * 2.0::double as cap from per),
levels as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0.0)) / sum(weight) over (o rows between current row and unbounded following) as level
           from weighed window o as (order by cap / weight, source nulls last)),
targets as (select *, case when max(case when level <= cap / weight then level end) over () is null then cap
                           else least(cap, max(case when level <= cap / weight then level end) over () * weight) end as target from levels),
rates as (select *, case when source_size > 0 then target / source_size else 0.0 end as rate from targets)
select s.doc_id, s.size, r.source_size, r.target::double as target,
       (s.size * (floor(r.rate) + case when ('0x' || substr(md5(coalesce(s.doc_id::varchar, md5(coalesce(s.text, ''))) || ':mix'), 1, 8))::bigint / 4294967296.0::double < r.rate - floor(r.rate) then 1 else 0 end))::bigint as taken
from sized s join rates r on s.source is not distinct from r.source""",
    "op11_conversation_repair": r"""
with recursive crc as (
  select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t),
keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])) as c
  from conversations, crc),
faulty as (select *, (4294967295 - c) % 20 as fault from keyed),
damaged as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
         case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from faulty, range(2) r(k) where fault <> 0 and (k = 0 or fault = 3)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
told as (select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as is_blank, row_number() over (partition by conv_id, role, text order by i) > 1 as is_seen,
         not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') as is_cut, left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by i) as prior from placed),
ways(s, more, t) as (values (0, '', 0), (0, 'u', 2), (0, 'ua', 3), (1, '', 1), (1, 'u', 2), (1, 'ua', 3), (2, '', 2), (2, 'a', 3), (3, '', 3), (3, 'u', 2)),
moves(s, r, t) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
edits as (
  select s, more, t, 'D' as edit, null as r from ways
  union all select w.s, w.more, m.t, 'K', m.r from ways w join moves m on w.t = m.s
  union all select w.s, w.more, m.t, 'R', m.r from ways w join moves m on w.t = m.s and m.r <> 's'),
names(more, lines) as (values ('', []::varchar[]), ('u', ['user:']), ('a', ['assistant:']), ('ua', ['user:', 'assistant:'])),
best as (
  select distinct conv_id, 0::bigint as i, 0 as s, 0::bigint as cost, '' as audit, []::varchar[] as body from conversations
  union all
  select * from (
    select b.conv_id, o.i, e.t as s, b.cost + 3 * len(e.more) + case e.edit when 'D' then 4 else case when e.edit = 'R' then 3 else 0 end + case when o.is_cut then 3 else 0 end end as cost,
           b.audit || repeat('I', len(e.more)) || e.edit as audit,
           b.body || n.lines || case e.edit when 'D' then [] when 'K' then [o.role || ':' || o.text] else [case e.r when 'u' then 'user:' else 'assistant:' end || o.text] end as body
    from best b join told o on b.conv_id is not distinct from o.conv_id and o.i = b.i + 1
    join edits e on e.s = b.s and (e.edit = 'D' or not (o.is_blank or o.is_seen) and (e.edit = 'R' or e.r = o.initial)) join names n on n.more = e.more)
  qualify row_number() over (partition by conv_id, s order by cost, audit) = 1),
ends as (
  select b.conv_id, b.cost + 3 * len(w.more) as cost, b.audit || repeat('I', len(w.more)) as audit, b.body || n.lines as body
  from best b join ways w on w.s = b.s and w.t in (0, 3) join names n on n.more = w.more
  qualify b.i = max(b.i) over (partition by b.conv_id)),
chosen as (select * from ends qualify row_number() over (partition by conv_id order by cost, audit) = 1),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (is_blank) as blank, count(*) filter (not is_blank and is_seen) as duplicate,
           count(*) filter (not is_blank and not is_seen and is_cut) as truncated, count(*) filter (prior || initial not in ('su', 'ua', 'au')) as illegal from told group by conv_id)
select c.conv_id, coalesce(n.gaps, 0)::bigint as gaps, coalesce(n.blank, 0)::bigint as blank, coalesce(n.duplicate, 0)::bigint as duplicate, coalesce(n.truncated, 0)::bigint as truncated,
       coalesce(n.illegal, 0)::bigint as illegal, c.cost::bigint as cost, c.audit, sha256(array_to_string(c.body, chr(10))) as repaired_sha256
from chosen c left join counts n on c.conv_id is not distinct from n.conv_id""",
    "op13_lexical_search": r"""
with terms as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
sizes as (select doc_id, count(*) as n from terms group by doc_id),
corpus as (select count(*) as docs, sum(n)::bigint as terms from sizes),
asked as (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
lists as (select term, doc_id, count(*) as tf from terms where term in (select term from asked) group by all),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from (select term, count(*) as df from lists group by term), corpus),
scored as (select item_id, l.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // corpus.terms))))::bigint as score
           from asked join weights using (term) join lists l using (term) join sizes s on s.doc_id = l.doc_id, corpus group by all)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10""",
}
