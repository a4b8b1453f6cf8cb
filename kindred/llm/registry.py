"""The queries of this package, as (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm import archive_files, archives, bpe, conversations, decontamination, language_id, media, near_duplicates, personal_data, repeated_passages, sharding, time_partitions, toxicity, url_filters
from kindred.plans.stored import drop, new_path, stored

#: Vocabulary of the word-end BPE; a file of the environment, never copied here.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Documents that score as much or more are toxic.
TOXIC_SCORE = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels, ~held_out())
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"))


def op8_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_features(media.media_column(table(spark, sf_dir, "documents")))
    pairs = F.concat_ws(";", F.concat_ws(",", F.col("times").cast("array<string>")), F.concat_ws(",", F.col("codes").cast("array<string>")))
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.concat(F.size("codes").cast("string"), F.lit(":"), F.sha2(pairs.cast("binary"), 256)).alias("feature"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.bpe_round_trip(table(spark, sf_dir, "documents"), VOCABULARY)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = stored(personal_data.candidate_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "candidates")
    found = personal_data.label_spans(candidates, personal_data.fit_spans(candidates))
    count = lambda k: F.expr(f"cast(size(filter(spans, c -> c.kind = '{k}')) as long)").alias(f"n_{k}")
    base, added = [count(k) for k in personal_data.BASE], [count(k) for k in personal_data.PATTERNS if k not in personal_data.BASE]
    digest = F.sha2(personal_data.span_text(kinds=personal_data.BASE).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *base, digest, personal_data.span_text().alias("spans"), F.size("spans").cast("long").alias("n_spans"), *added)


def op3_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.balanced_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base kinds of op2 alone."""
    return op2_personal_data(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in personal_data.BASE], "base_sha256")


def shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of op3's shards from the largest down, whether their slots are 0 to n - 1, and all bytes and different texts."""
    placed = stored(op3_balanced_shards(spark, sf_dir), "placed")
    docs = table(spark, sf_dir, "documents")
    every = spark.range(40).select(F.col("id").cast("int").alias("shard"))
    sizes = placed.groupBy("shard").agg(F.count("*").alias("n_rows"), (F.count_distinct("slot") == F.count("*")).alias("once"), F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    told = every.join(sizes, "shard", "left").select(F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce(F.col("once") & (F.col("lo") == 0) & (F.col("hi") == F.col("n_rows") - 1), F.lit(True)).alias("gapless"))
    ranked = told.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_rows"))))  # 40 rows
    whole = placed.agg(F.sum("size").alias("bytes"))
    return ranked.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(docs.agg(F.count_distinct(F.coalesce("text", F.lit(""))).alias("groups")))).select("rank", "n_rows", "gapless", "bytes", "groups")


def _capture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch time: the tables have none, so the id gives a day of 2024."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_at"))


def _list_entries(captures: DataFrame) -> DataFrame:
    """A dated list log about the hosts of the pages, derived from the digest of each host."""
    hosts = captures.select(url_filters.host_of("url").alias("host")).where("host <> ''").distinct().withColumn("m", F.md5(F.col("host").cast("binary")))
    digit = lambda i: f"(instr('0123456789abcdef', substr(m, {i}, 1)) - 1)"
    since = f"({digit(1)} * 16 + {digit(2)})"
    last = f"({since} + {digit(3)} * 8 + 1)"
    name = f"case when {digit(4)} < 6 then 'adult' when {digit(4)} < 11 then 'malware' else 'spam' end"
    day = lambda n: f"date_add(date'2024-01-01', cast({n} as int))"
    log = []
    for condition, kind, value, action, at in (
        (f"{digit(5)} < 8", "host", "host", "add", since),
        (f"{digit(5)} < 8", "host", "host", "remove", last),
        (f"{digit(5)} < 3", "host", "host", "add", f"{last} + 20"),
        (f"{digit(5)} >= 12", "domain", "regexp_replace(host, '^(www|m|blog)[.]', '')", "add", since),
        (f"{digit(6)} < 4", "prefix", "concat(host, '/en')", "add", last),
    ):
        log.append(hosts.where(condition).selectExpr(f"{name} as list", f"'{kind}' as kind", f"{value} as value", f"'{action}' as action", f"{day(at)} as at"))
    out = log[0]
    for more in log[1:]:
        out = out.union(more)
    return out


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = _capture_rows(spark, sf_dir)
    entries = stored(_list_entries(captures), "entries")
    found = url_filters.evaluate_captures(captures, entries)
    drop(entries)
    return found.select("page_id", "host", "n_entries", F.concat_ws(",", "lists").alias("lists"), (F.col("n_entries") > 0).alias("blocked"))


OP4_SQL = r"""
with captures as (
  select row_number() over () rid, page_id, url, date '2024-01-01' + cast(page_id * 37 % 365 as int) as t,
         rtrim(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1), '.') as host,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1) as path
  from pages),
hosts as (select distinct host, md5(host) m from captures where host <> ''),
d as (select host, [instr('0123456789abcdef', substr(m, i, 1)) - 1 for i in range(1, 7)] x from hosts),
e as (select host, x, x[1] * 16 + x[2] as since, x[1] * 16 + x[2] + x[3] * 8 + 1 as last,
             case when x[4] < 6 then 'adult' when x[4] < 11 then 'malware' else 'spam' end as list from d),
log as (
  select list, 'host:' || host as key, 'add' as action, since as day from e where x[5] < 8
  union all select list, 'host:' || host, 'remove', last from e where x[5] < 8
  union all select list, 'host:' || host, 'add', last + 20 from e where x[5] < 3
  union all select list, 'domain:' || regexp_replace(host, '^(www|m|blog)[.]', ''), 'add', since from e where x[5] >= 12
  union all select list, 'prefix:' || host || '/en', 'add', last from e where x[6] < 4),
final as (select list, key, day, max(action) as action from log group by all),
changed as (select *, lag(action) over (partition by list, key order by day) as before from final),
spans as (
  select list, key, action, date '2024-01-01' + cast(day as int) as since, date '2024-01-01' + cast(lead(day) over (partition by list, key order by day) as int) as until
  from changed where action <> coalesce(before, 'remove')),
keys as (
  select rid, t, 'host:' || host as key from captures where host <> ''
  union select rid, t, 'domain:' || array_to_string(string_split(host, '.')[i:], '.') from captures, unnest(range(1, len(string_split(host, '.')) + 1)) u(i) where host <> ''
  union select rid, t, 'prefix:' || host || '/' || array_to_string(string_split(path, '/')[1:i], '/') from captures, unnest(range(1, len(string_split(path, '/')) + 1)) u(i) where host <> '' and path <> ''),
met as (
  select rid, count(*) n, array_to_string(list_sort(list(distinct list)), ',') lists
  from keys join spans using (key) where action = 'add' and since <= t and (until is null or t < until) group by rid)
select page_id, host, coalesce(n, 0) as n_entries, coalesce(lists, '') as lists, coalesce(n, 0) > 0 as blocked
from captures left join met using (rid)
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.concat_ws(",", "items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    legacy = archives.legacy_archives(table(spark, sf_dir, "pages"))
    found = archives.read_archives(archives.convert_archives(legacy))
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").alias("refers_to"))


def warc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives of op6 as .warc.gz files in a new folder, read back from there."""
    folder = new_path(spark, "warc-files")
    made = archives.convert_archives(archives.legacy_archives(table(spark, sf_dir, "pages")))
    archive_files.save_archives(made, folder).write.format("noop").mode("overwrite").save()
    found = archives.read_archives(archive_files.open_archives(spark, folder))
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").alias("refers_to"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the contract removes, and the passages of more than 50 words that repeat, most of which are shorter than its 400 bytes."""
    found = repeated_passages.repeats_and_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), *_said())


def repeated_word_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of more than 50 words that repeat, whatever white space is between the words."""
    found = repeated_passages.word_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_said())


def _said() -> list:
    words = F.aggregate("passages", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return [F.size("passages").cast("long").alias("n_passages"), words.alias("n_passage_words")]


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_components(table(spark, sf_dir, "documents"), near_duplicates.NearDuplicates(shingle=3, percent=85))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit_languages(docs, ~held_out())
    found = language_id.identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


#: A click's moment: some are moved back by days, some to the Monday before.
CLICK_MOMENT = """
case when crc32(cast(cast(click_id as string) as binary)) % 128 < 16 then cast(ts as timestamp_ntz) - make_dt_interval(cast(pow(crc32(cast(cast(click_id as string) as binary)) % 128 + 6, 3) as int))
     when crc32(cast(cast(click_id as string) as binary)) % 128 > 111 then cast(date_sub(next_day(cast(ts as date), 'MO'), 7) as timestamp_ntz)
     else cast(ts as timestamp_ntz) end"""
#: Clicks that arrived before are there when the layout is created, the rest is added.
CLICKS_SINCE = "2024-04-01 00:00:00"


def op12_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "clicks")
    limit = 1 + clicks.count() // 800
    first = F.coalesce(F.col("arrived_at") < F.lit(CLICKS_SINCE).cast("timestamp_ntz"), F.lit(False))
    layout = time_partitions.create_layout(clicks.where(first), new_path(spark, "clicks"), limit, CLICK_MOMENT, ("arrived_at", "click_id"))
    layout = time_partitions.add_rows(layout, clicks.where(~first))
    return layout.files.select("leaf", "part", F.lit(",".join(clicks.columns)).alias("columns"), "n_rows", "n_new", "ids_sha256", "path", "rewritten")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(conversations.damaged(table(spark, sf_dir, "conversations")))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP5_SQL = rf"""
with d as (select row_number() over () rid, doc_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
i as (select item_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark),
windows as (select distinct item_id, list_slice(w, s, least(s + 9, len(w))) ws from i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(s) where len(w) > 0),
sizes as (select distinct len(ws) n from windows),
places as (select rid, s, n, list_slice(w, s, s + n - 1) ws from d, sizes, unnest(range(1, len(w) - n + 2)) t(s) where len(w) >= n),
hits as (select rid, s, n, item_id from places join windows using (ws)),
covered as (select rid, count(distinct p) n_hit from (select rid, unnest(range(s, s + n)) p from hits) group by rid),
items as (select rid, count(distinct item_id) n_items, array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') ids from hits group by rid)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (rid) left join items using (rid)
"""
OP9_SQL = rf"""
with recursive d as (select doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
g as (
  select distinct doc_id, list_slice(w, s, s + 2) g from d, unnest(range(1, len(w) - 1)) t(s) where len(w) >= 3
  union all select doc_id, w from d where len(w) between 1 and 2),
n as (select doc_id, count(*) n from g group by 1),
common as (select a.doc_id x, b.doc_id y, count(*) c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from common join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
hops as (select x, y from links union select y, x from links),
walk(v, m) as (select x, x from hops union select h.x, w.m from walk w join hops h on h.y = w.v and w.m < h.x),
components as (select v, min(m) m from walk group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m, d.doc_id) as component_id, coalesce(m, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join components on v = d.doc_id
"""

# five hexadecimal digits of the SHA-1 are four of base32
OP6_SQL = """
with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages),
g as (select *, max(page_id) over (partition by t) as top, list_transform(range(0, 8), lambda j: cast('0x' || substr(h, cast(5 * j + 1 as bigint), 5) as bigint)) as v from p)
select page_id, cast(strlen(t) as bigint) as payload_bytes,
       array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((x >> k) & 31 as bigint) + 1, 1)), '')), '') as payload_digest,
       case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to
from g
"""

# Spans of the base kinds: what lies between matches and the matches themselves give the places.
PERSONAL_SQL = r"""
with kinds as (
  select * from (values (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), (3, 'card', '[0-9](?:[\x20-]?[0-9])+'), (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')) v(place, kind, pattern)),
d as (select row_number() over () rid, doc_id, coalesce(text, '') as t from documents),
found as (select rid, place, kind, regexp_extract_all(t, pattern) as m, string_split_regex(t, pattern) as p from d, kinds),
each as (
  select rid, place, kind, m[i] as s, cast(list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) as bigint) as start
  from found, unnest(range(1, len(m) + 1)) u(i)),
judged as (
  select *, start + length(s) as stop, regexp_replace(s, '[^0-9]', '', 'g') as digits from each),
spans as (
  select * from judged where case kind
    when 'email' then true
    when 'ip' then len(list_filter(string_split(s, '.'), lambda x: len(ltrim(x, '0')) > 3 or coalesce(try_cast(ltrim(x, '0') as int), 0) > 255)) = 0
    when 'card' then length(digits) between 16 and 19 and list_sum([cast(substr(digits, k, 1) as int) * (1 + (length(digits) - k) % 2) - case when (length(digits) - k) % 2 = 1 and cast(substr(digits, k, 1) as int) > 4 then 9 else 0 end for k in range(1, length(digits) + 1)]) % 10 = 0
    else length(digits) between 8 and 15 end),
told as (
  select rid, count_if(kind = 'email') n_email, count_if(kind = 'ip') n_ip, count_if(kind = 'card') n_card, count_if(kind = 'phone') n_phone, string_agg(kind || ':' || start || ':' || stop, ',' order by place, start) as listed from spans group by 1)
select doc_id, cast(coalesce(n_email, 0) as bigint) as n_email, cast(coalesce(n_ip, 0) as bigint) as n_ip, cast(coalesce(n_card, 0) as bigint) as n_card, cast(coalesce(n_phone, 0) as bigint) as n_phone, sha256(coalesce(listed, '')) as base_sha256
from d left join told using (rid)
"""

SHARDS_SQL = """
with n as (select count(*) as n from documents), g as (select count(*) as groups from (select distinct coalesce(text, '') from documents))
select cast(r as int) as rank, cast(n // 40 + case when r <= n % 40 then 1 else 0 end as bigint) as n_rows, true as gapless, (select sum(strlen(coalesce(text, '')) + 16) from documents)::bigint as bytes, groups
from n, g, unnest(range(1, 41)) u(r)
"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_personal_data": op2_personal_data,
    "op3_balanced_shards": op3_balanced_shards,
    "op4_url_filters": op4_url_filters,
    "op5_decontamination": op5_decontamination,
    "op6_arc_to_warc": op6_arc_to_warc,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_media_fingerprints": op8_media_fingerprints,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_bpe": op10_bpe,
    "op11_language": op11_language,
    "op12_time_partitions": op12_time_partitions,
    "op13_conversation_repair": op13_conversation_repair,
    "personal_data_base": personal_data_base,
    "repeated_word_passages": repeated_word_passages,
    "shard_laws": shard_laws,
    "warc_files": warc_files,
}
ORACLES: dict[str, str] = {"op4_url_filters": OP4_SQL, "op5_decontamination": OP5_SQL, "op6_arc_to_warc": OP6_SQL, "op9_near_duplicates": OP9_SQL, "personal_data_base": PERSONAL_SQL, "shard_laws": SHARDS_SQL}
