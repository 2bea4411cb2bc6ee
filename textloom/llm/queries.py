"""The queries opN_<name> over the whole tables, and their SQL where DuckDB can express it."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import conversation_repair, decontamination, hard_negatives, html_extraction, language_id, line_dedup, near_dedup, sentencepiece_codec, sharding, substring_dedup, token_counts, token_store, topk_search, vector_packs
from textloom.llm.common import documents, scratch_path

END_ID = 1
TOKEN_LIMIT = 2048
SHARDS = 8


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_store.write_store(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_store.scan(token_store.read_store(spark, path), token_store.crc32_of_ids, "ids_crc32 long", token_store.CRC32)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_words(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), TOKEN_LIMIT)


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", vector_packs.whole_numbers(F.col("embedding"), 256).alias("vector"))
    return topk_search.top_k(vectors, F.col("id") % 50 == 0, 5)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_codec.encoded(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip", "n_different")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = language_id.fold_of(F.col("id")) == 2
    found = language_id.language_of(documents(spark, sf_dir), ~held_out)
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score", "entropy")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir), SHARDS)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    given = vectors.select("vec_id", vector_packs.whole_numbers(F.col("embedding"), 256).alias("vector"), label.alias("label"))
    return hard_negatives.hard_negatives(given, F.col("id") % 100 == 0)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults of known kinds, dealt by crc32 of `conv_id:turn` (null: one space), of twenty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("dealt"))
    changed = dealt.where("dealt <> 0").withColumns({
        "text": F.when(F.col("dealt") == 1, "").when(F.col("dealt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("dealt") == 4, "user").otherwise(F.col("role")),
    })
    return changed.withColumn("copy", F.explode(F.when(F.col("dealt") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("dealt", "copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = conversation_repair.repaired(damaged(rows)).conversations.withColumnRenamed("conv", "of")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    none = {c: F.coalesce(c, F.lit(0)) for c in counts} | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").withColumns(none).select("conv_id", *counts, "audit", "repaired_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_ids, op2_minhash_near_dedup, op3_line_dedup, op4_substring_dedup, op5_decontamination, op6_token_counts, op7_topk_search, op8_sentencepiece, op9_language_id, op10_sharding, op11_hard_negatives, op12_html_extraction, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": OP2_SQL, "op3_line_dedup": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op5_decontamination": OP5_SQL, "op7_topk_search": OP7_SQL, "op10_sharding": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_html_extraction": OP12_SQL, "op13_conversation_repair": OP13_SQL}


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
    with l as (
        select doc_id, generate_subscripts(parts, 1) as i, unnest(parts) as line
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)),
    k as (select *, {LOWER.format(f"trim(line, {BLANKS})")} as key from l),
    f as (select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3)
    select k.doc_id, count(*)::bigint as n_lines, count(*) filter (where f.last <> k.doc_id)::bigint as n_dropped,
           sha256(coalesce(string_agg(k.line, chr(10) order by k.i) filter (where f.last is null or f.last = k.doc_id), '')) as kept_sha256
    from k left join f on f.key = k.key group by k.doc_id"""

WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

OP2_SQL = f"""
    with recursive w as (select doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} as w from documents),
    s as (select doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) as s from w where len(w) > 0),
    n as (select doc_id, count(*)::bigint as n from s group by doc_id),
    c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
    l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
    e as (select a, b from l union all select b, a from l),
    r(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on e.a = r.other),
    m as (select doc_id, min(other) as component_id from r group by doc_id)
    select m.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, m.doc_id = component_id as kept from m left join n on n.doc_id = m.doc_id"""

OP4_SQL = f"""
    with w as (select doc_id, {WORDS.format("coalesce(text, '')")} as w from documents),
    g as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50)),
    f as (select h, min(doc_id) as least from g group by h),
    p as (select distinct doc_id, unnest(range(i, i + 50)) as p from g join f using (h) where least < doc_id),
    k as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from w),
    s as (select k.doc_id, count(*) filter (where p.p is not null) as n, string_agg(word, ' ' order by k.p) filter (where p.p is null) as t from k left join p on p.doc_id = k.doc_id and p.p = k.p group by k.doc_id)
    select w.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join s on s.doc_id = w.doc_id"""

#: CRC-32 byte by byte, with its table t.
CRC_TABLE = """b(i, k, v) as (select i, 0, i from range(256) t(i) union all select i, k + 1, xor(v >> 1, case when v & 1 = 1 then 3988292384 else 0 end) from b where k < 8),
    t as (select list(v order by i) as t from b where k = 8)"""
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: ('0x' || x)::bigint)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)"

#: A jump goes from b to floor((b + 1) * 2**32 / (draw + 1)).
OP10_SQL = f"""
    with recursive {CRC_TABLE},
    d as (select doc_id, coalesce(text, '') as text, coalesce(doc_id::varchar, 'null') as key from documents),
    c as (select doc_id, key, strlen(text) + 1 as size,
        case when text = '' then 0 else {CRC.format("text")} end as crc from d, t),
    j(key, shards, here, there, step) as (
        select key, n, 0::bigint, 0::bigint, 0 from (select distinct key from d), (values (8), (9)) s(n)
        union all select key, shards, there, floor((there + 1) * 4294967296.0::double / (('0x' || substr(md5(key || ':' || (step + 1)), 1, 8))::bigint + 1))::bigint, step + 1 from j where there < shards),
    g as (select key, max(here) filter (where shards = 8) as shard, max(here) filter (where shards = 9) as grown from j group by key)
    select doc_id, size::bigint as size, crc::bigint as text_crc32, 'key' as law, shard::int as shard, row_number() over (partition by shard order by doc_id nulls first, crc, size) - 1 as slot, grown::int as grown_shard
    from c join g on g.key = c.key"""

OP7_SQL = """
    with v as (
        select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (
        select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
        from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
    select query_id, rank::int as rank, vec_id, score from r where rank <= 5"""

OP11_SQL = """
    with v as (
        select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
        where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (
        select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::bigint as score
        from v a join v c on c.vec_id <> a.vec_id where a.vec_id % 100 = 0),
    p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
    n as (
        select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
        from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
    select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10"""

OP5_WORDS = f"list_filter(string_split_regex({LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

OP5_SQL = f"""
    with d as (select doc_id, {OP5_WORDS} as w from documents),
    b as (select item_id::varchar as item_id, {OP5_WORDS} as w from benchmark),
    iw as (select distinct item_id, n, unnest(runs) as run
           from (select item_id, least(len(w), 10) as n, list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda s: array_to_string(w[s:s + least(len(w), 10) - 1], ' ')) as runs from b where len(w) > 0)),
    n as (select distinct n from iw),
    dw as (select doc_id, n, unnest(runs) as run, generate_subscripts(runs, 1) as s
           from (select doc_id, n, list_transform(range(1, greatest(len(w) - n + 1, 0) + 1), lambda s: array_to_string(w[s:s + n - 1], ' ')) as runs from d, n)),
    h as (select dw.doc_id, dw.s, dw.n, iw.item_id from dw join iw on iw.n = dw.n and iw.run = dw.run),
    c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from h) group by doc_id),
    i as (select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items from (select distinct doc_id, item_id from h) group by doc_id)
    select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(i.n_items, 0)::bigint as n_items,
           coalesce(i.items, sha256('')) as items_sha256, c.n_hit is not null as contaminated
    from d left join c using (doc_id) left join i using (doc_id)"""

#: The pages at hand all have one article of headings and paragraphs, and character references of four kinds.
OP12_SQL = """
    with b as (
        select page_id, url, list_filter(list_transform(string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(?:p|h1)>'), lambda b: trim(regexp_replace(
            regexp_replace(b, '<br>', ' ', 'g').regexp_replace('<[^>]*>', '', 'g').replace('&lt;', '<').replace('&gt;', '>').replace('&quot;', '"').regexp_replace('&amp;?', '&', 'g'), '\\s+', ' ', 'g'))), lambda b: b <> '') as blocks
        from pages)
    select page_id, url, coalesce(array_to_string(blocks, chr(10) || chr(10)), '') as text, length(coalesce(array_to_string(blocks, chr(10) || chr(10)), ''))::bigint as n_chars from b"""

#: v: for each row (and the end) the cost to go on from the states nothing, s, u, a; p: the cheapest edits, one by one, the first in the alphabet of those that keep to it.
OP13_SQL = f"""
    with recursive {CRC_TABLE},
    k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
    c as (select k.*, {CRC.format("key")} % 20 as dealt from k, t),
    d as (
        select conv_id, turn, case dealt when 4 then 'user' else role end as role, case dealt when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
        from c, (values (1), (2)) x(copy) where dealt <> 0 and (copy = 1 or dealt = 3)),
    o as (select *, row_number() over (partition by conv_id order by turn nulls first, md5(role || ':' || text)) as i from d),
    x as (
        select *, case when rest = '' then 'b' when nth > 1 then 'd' when right(rest, 1) not in ('.', '!', '?') then 't' else '' end as fault
        from (select *, left(role, 1) as initial, rtrim(text, {BLANKS}) as rest, row_number() over (partition by conv_id, role, text order by i) as nth from o)),
    y as (select *, case fault when '' then 0 when 't' then 5 else 1000000000 end as more, lag(initial) over (partition by conv_id order by i) || initial as pair from x),
    n as (
        select conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'b') as blank, count(*) filter (where fault = 'd') as duplicate,
               count(*) filter (where fault = 't') as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal
        from y group by conv_id),
    v(conv_id, i, v) as (
        select conv_id, n + 1, [0, 10, 5, 0] from n
        union all
        select conv_id, i, [least(w[1], 5 + w[3], 10 + w[4]), least(w[2], 5 + w[3], 10 + w[4]), least(w[3], 5 + w[4], 10 + w[3]), least(w[4], 5 + w[3], 10 + w[4])]
        from (select y.conv_id, y.i, [
                least(2 + v[1], more + 1 + v[3], case initial when 's' then more + v[2] when 'u' then more + v[3] end), least(2 + v[2], more + (initial <> 'u')::int + v[3]),
                least(2 + v[3], more + (initial <> 'a')::int + v[4]), least(2 + v[4], more + (initial <> 'u')::int + v[3])] as w
              from v join y on y.conv_id is not distinct from v.conv_id and y.i = v.i - 1)),
    p(conv_id, i, s, audit, lines) as (
        select conv_id, 1::bigint, 1, '', []::varchar[] from n
        union all
        select conv_id, i + (e <> 'I')::int, case e when 'D' then s when 'K' then case initial when 's' then 2 when 'u' then 3 else 4 end else after end, audit || e,
               case e when 'D' then lines when 'K' then list_append(lines, role || ':' || text) else list_append(lines, case after when 3 then 'user:' else 'assistant:' end || case e when 'R' then text else '' end) end
        from (select p.*, y.initial, y.role, y.text, case s when 3 then 4 else 3 end as after,
                     case when 2 + u.v[s] = v.v[s] then 'D' when 5 + v.v[case s when 3 then 4 else 3 end] = v.v[s] then 'I'
                          when more + case when initial = 's' and s = 1 then u.v[2] when initial = 'u' and s <> 3 then u.v[3] when initial = 'a' and s = 3 then u.v[4] end = v.v[s] then 'K' else 'R' end as e
              from p join n on n.conv_id is not distinct from p.conv_id join v on v.conv_id is not distinct from p.conv_id and v.i = p.i
              left join v u on u.conv_id is not distinct from p.conv_id and u.i = p.i + 1 left join y on y.conv_id is not distinct from p.conv_id and y.i = p.i
              where not (p.i = n + 1 and s in (1, 4))))
    select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
           coalesce(v.v[1], 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) as repaired_sha256
    from (select distinct conv_id from conversations) a left join n on n.conv_id is not distinct from a.conv_id
    left join v on v.conv_id is not distinct from a.conv_id and v.i = 1 left join p on p.conv_id is not distinct from a.conv_id and p.i = n.n + 1 and p.s in (1, 4)"""
